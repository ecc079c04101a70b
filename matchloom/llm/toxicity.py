"""Toxicity by multiple-instance learning.

A document is a bag of sentences; it is toxic if at least one sentence is. Each sentence has a
logistic score over its distinct words and their beginnings (PREFIXES letters), the scores are combined by noisy-or, and the sentence model is
trained from document labels alone. Sentences at or over one half locate the offence.

The model is fitted on a bounded sample of labelled rows (TRAIN_DOCS rows of each class, texts of
at most TRAIN_CHARS characters); scoring reads every whole text. Null and empty texts hold no
sentence and score 0. Without labels of both classes every score is 0. Rows are never merged, other
columns are ignored, an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices, smallest_by_hash

TRAIN_DOCS, TRAIN_CHARS = 4000, 20_000
MIN_DOCS, MAX_FEATURES = 10, 60_000
PREFIXES = (3, 4, 5)
#: Words whose summed weights a worker keeps.
HELD = 200_000
#: Words of an instance at most; a longer sentence is several instances.
SENTENCE_WORDS = 60
ROUNDS, RATE, DECAY = 300, 0.15, 1e-5
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")
SCHEMA = "doc_id long, score double, spans array<struct<start:int,stop:int,score:double>>"


@dataclass
class SentenceModel:
    """Feature weights and bias of the logistic sentence score."""

    weights: dict[str, float]
    bias: float


def sentences(text: str):
    """start, stop and distinct lower-case words of each instance."""
    for m in SENTENCE.finditer(text):
        ws = WORD.findall(m[0].lower())
        if len(ws) <= SENTENCE_WORDS:
            if ws:
                yield m.start(), m.end(), ws
        else:
            spans = [(x.start(), x.end()) for x in WORD.finditer(m[0])]
            for at in range(0, len(spans), SENTENCE_WORDS):
                part = spans[at : at + SENTENCE_WORDS]
                start, stop = m.start() + part[0][0], m.start() + part[-1][1]
                yield start, stop, WORD.findall(text[start:stop].lower())


def features(word: str) -> list[str]:
    """The word itself and its beginnings, marked so that they differ from words."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def fit(texts: list[str], toxic: list[int]) -> SentenceModel:
    """Full-batch Adam on the noisy-or likelihood, with decay on the weights, which are kept at or above 0.

    So a word can only add to the evidence, and an offence counts whatever stands beside it.

    A sentence adds up its distinct words, a word its features, so sums run over words and then over features.
    """
    words: dict[str, int] = {}
    word, sentence, doc = array("i"), array("i"), array("i")
    n = 0
    for d, t in enumerate(texts):
        for *_, ws in sentences(t):
            own = [words.setdefault(w, len(words)) for w in set(ws)]
            word.extend(own)
            sentence.extend([n] * len(own))
            doc.append(d)
            n += 1
    word, sentence, doc = (np.frombuffer(x, dtype=np.int32) if len(x) else np.empty(0, np.int32) for x in (word, sentence, doc))
    if not n or len(set(toxic)) < 2:
        return SentenceModel({}, -50.0)
    spots = np.unique(doc[sentence].astype(np.int64) * len(words) + word)
    spots = np.bincount(spots % len(words), minlength=len(words)).tolist()  # documents of each word
    seen: dict[str, int] = {}  # at least the documents of each feature
    for w, i in words.items():
        for f in features(w)[spots[i] < MIN_DOCS :]:
            seen[f] = seen.get(f, 0) + spots[i]
    best = sorted((f for f, k in seen.items() if k >= MIN_DOCS), key=lambda f: (-seen[f], f))[:MAX_FEATURES]
    names = {f: i for i, f in enumerate(best)}
    of_word, of_feature, size = array("i"), array("i"), len(names)
    for w, i in words.items():
        for f in features(w):
            if (j := names.get(f)) is not None:
                of_word.append(i)
                of_feature.append(j)
    of_word, of_feature = (np.frombuffer(x, dtype=np.int32) if len(x) else np.empty(0, np.int32) for x in (of_word, of_feature))
    del seen, spots
    y = np.array(toxic, dtype=float)
    v, bias = np.zeros(size), -6.0
    m1, m2 = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, ROUNDS + 1):
        z = bias + np.bincount(sentence, np.bincount(of_word, v[of_feature], len(words))[word], n)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        miss = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)))
        bag_p = np.clip(1 - miss, 1e-9, 1)
        g = p * (1 - y[doc] / bag_p[doc])
        by_word = np.bincount(word, g[sentence], len(words))
        grad = np.append(np.bincount(of_feature, by_word[of_word], size), g.sum()) / len(y)
        grad[:-1] += DECAY * v
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad**2
        move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        v, bias = np.maximum(0, v - move[:-1]), bias - move[-1]
    return SentenceModel({f: float(v[i]) for f, i in names.items() if v[i] > 0.02}, float(bias))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> SentenceModel:
    """Fit on the labelled rows of smallest hash: at most max_docs of each class, texts up to max_chars.

    labels has doc_id and toxic. One task fits the model on this bounded sample; the driver holds its weights alone.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = smallest_by_hash(known.where("toxic = 1"), ["doc_id"], max_docs).unionByName(smallest_by_hash(known.where("toxic = 0"), ["doc_id"], max_docs))
    small = F.broadcast(chosen)  # 2 * max_docs rows of two numbers at most
    rows = docs.where(F.length("text") <= max_chars).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def learn(sample: pa.Table) -> pa.Table:
        by_id = sample.sort_by("doc_id")
        model = fit(by_id.column("text").to_pylist(), by_id.column("toxic").to_pylist())
        give_back()
        return pa.table({"feature": pa.array(["", *model.weights], pa.string()), "weight": pa.array([model.bias, *model.weights.values()], pa.float64())})

    got = rows.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(learn, "feature string, weight double").collect()  # MAX_FEATURES rows at most
    weights = {r[0]: r[1] for r in got}
    bias = weights.pop("", -50.0)
    return SentenceModel(weights, bias)


def score_function(model: SentenceModel, at_least: float = 0.5):
    """From a text to its noisy-or score and the spans of its sentences that reach at_least."""
    weights, bias = model.weights, model.bias
    known: dict[str, float] = {}

    def judge(text: str | None):
        spans, miss = [], 0.0
        for start, stop, ws in sentences(text or ""):
            z = bias
            for w in set(ws):
                x = known.get(w)
                if x is None:
                    if len(known) > HELD:
                        known.clear()
                    x = known[w] = sum(weights.get(f, 0.0) for f in features(w))
                z += x
            if z < -30:
                continue
            p = 1 / (1 + math.exp(-min(z, 40.0)))
            miss += math.log1p(-min(p, 1 - 1e-12))
            if p >= at_least:
                spans.append({"start": start, "stop": stop, "score": p})
        return min(1.0, max(0.0, -math.expm1(miss))), spans

    def done() -> None:
        known.clear()
        give_back()

    judge.done = done
    return judge


def score(docs: DataFrame, model: SentenceModel, at_least: float = 0.5) -> DataFrame:
    """doc_id, score of the whole text, and the spans of sentences that reach at_least."""
    judge = score_function(model, at_least)

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
        for batch in slices(batches, 500):
            got = [judge(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], kind)],
                ["doc_id", "score", "spans"],
            )
        judge.done()

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, model: SentenceModel, below: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is below the bound."""
    at = docs.columns.index("text")
    judge = score_function(model)

    def run(batches):
        for batch in slices(batches, 500):
            keep = [judge(t.as_py())[0] < below for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))
        judge.done()

    return docs.mapInArrow(run, docs.schema)
