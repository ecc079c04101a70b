"""Plain single-process versions of the operators' results."""

import math
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return [w.decode() for w in WORD.findall((text or "").encode())]


def simhash(text, size=3):
    ws = words(lower(text))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """Smallest id of each node's component; nodes: list of (id, value), linked(value, value)."""
    parent = list(range(len(nodes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i][1], nodes[j][1]):
                parent[root(i)] = root(j)
    best = defaultdict(list)
    for i, (doc, _) in enumerate(nodes):
        if doc is not None:
            best[root(i)].append(doc)
    return [min(best[root(i)], default=None) for i in range(len(nodes))]


def phrases(text, known):
    ws = LICENSE_WORD.findall(lower(text))
    found = []
    for phrase, label in known.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
    return len(ws), sorted(found)


def repeated_words(docs, window=13):
    """Per (doc_id, text): words kept after removing windows that start in a smaller doc_id."""
    first = {}
    for d, t in docs:
        ws = words(t)
        if d is not None:
            for i in range(len(ws) - window + 1):
                key = tuple(ws[i : i + window])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, t in docs:
        ws = words(t)
        gone = set()
        if d is not None:
            for i in range(len(ws) - window + 1):
                if first[tuple(ws[i : i + window])] < d:
                    gone.update(range(i, i + window))
        out.append((d, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def repeated_lines(docs, run=3, least=13):
    """Per document its lines left and removed: those in stretches of `run` lines, or of fewer with `least` words, that also stand at an earlier place."""
    places, numbered = {}, []
    for d, t in docs:
        raw = (t or "").split("\n")
        at = [i for i, x in enumerate(raw) if x.strip(" \t\r\x0b\f")]
        numbered.append((d, t, raw, at))
    order = lambda d, t: (d is None, d or 0, t or "")
    size = lambda x: len(re.findall(r"[^ \t\r\x0b\f]+", x))

    def stretches(raw, at):
        for p in range(len(at)):
            for n in range(1, run + 1):
                lines = tuple(raw[i] for i in at[p : p + n])
                if len(lines) == n and (n == run or sum(map(size, lines)) >= least):
                    yield p, n, lines

    for d, t, raw, at in numbered:
        for p, _, lines in stretches(raw, at):
            places[lines] = min((order(d, t), p), places.get(lines, (order(d, t), p)))
    out = []
    for d, t, raw, at in numbered:
        gone = set()
        for p, n, lines in stretches(raw, at):
            if places[lines] < (order(d, t), p):
                gone.update(at[p : p + n])
        out.append((d, len(at), len(gone), None if t is None else "\n".join(x for i, x in enumerate(raw) if i not in gone)))
    return out


def quality(text):
    text = text or ""
    ws = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    threes = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    often = Counter(threes)
    hit = {j for i, x in enumerate(threes) if often[x] > 1 for j in (i, i + 1, i + 2)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def jaccard(a, b, size=5):
    x, y = ({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set() for w in (words(lower(a)), words(lower(b))))
    return len(x & y) / len(x | y) if x | y else 1.0


def noisy_or(text, weights, bias, words_at_most=60):
    """The probability that some sentence is toxic: sentences end at . ! ? and line feeds, long ones are cut."""
    miss = 1.0
    for sentence in re.split(r"[.!?\n]", text or ""):
        ws = re.findall(r"[^\W_]+", sentence)
        for i in range(0, len(ws), words_at_most):
            known = {w for x in ws[i : i + words_at_most] for w in re.findall(r"[^\W_]+", x.lower())}
            z = bias + sum(weights.get(f, 0.0) for w in known for f in [w, *(w[:n] + "*" for n in (3, 4, 5) if len(w) > n)])
            miss *= 1 - 1 / (1 + math.exp(-max(-700.0, min(z, 700.0))))
    return 1 - miss


def isolation_score(forest, row):
    """The anomaly of one row: its mean path length over the trees, each walked node by node."""
    total = 0.0
    for column, cut, left, right, path in forest.grown:
        node = 0
        while left[node] != node:
            node = left[node] if row[column[node]] < cut[node] else right[node]
        total += path[node]
    return 2.0 ** (-total / len(forest.grown) / forest.norm)


def license_cover(text, template, k=3):
    """The largest share of a template's words that stand, in k-grams of equal words, near one diagonal of the text."""
    ws, t = LICENSE_WORD.findall(lower(text)), LICENSE_WORD.findall(lower(template))
    hits = defaultdict(set)
    for i in range(len(ws) - k + 1):
        for j in range(len(t) - k + 1):
            if ws[i : i + k] == t[j : j + k]:
                hits[i - j].update(range(j, j + k))
    reach = max(2, len(t) // 10)
    return max((len(set().union(*(s for e, s in hits.items() if abs(e - d) <= reach))) / len(t) for d in hits), default=0.0)
