"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, spread, stored, stored_at

#: Size of a key filter as a power of two, in bits: smallest, largest; and bits for each key until the largest is reached.
FILTER_POWERS, FILTER_BITS = (15, 28), 8
#: A key is hot if it holds more than one in so many of all rows; so there are no more hot keys than this.
HOT_SHARE = 10_000

__all__ = ["discard", "stored", "stored_at"]

#: Lower-cases A-Z and nothing else, on UTF-8 bytes.
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str, in_order: bool = False) -> DataFrame:
    """A table; one of fewer splits than cores is dealt out, unless its rows are wanted in the order of the files."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df if in_order else spread(df)


def smallest_by_hash(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """The rows of smallest key hash, at most `rows`: a sample that any rerun repeats.

    Only about that share of the hash range is sorted, so tasks send the driver little, however many they are.
    """
    share = min(1.0, 1.3 * (rows + 100) / max(df.count(), 1))
    order = F.xxhash64(*keys)
    few = df if share == 1.0 else df.where(order < F.lit(int(share * 2**64) - 2**63))
    return few.orderBy(order, *keys).limit(rows)


@dataclass
class KeyFilter:
    """A bitmap over the leading bits of hashed keys, at most 32 MB whatever their number; it lets through all keys and a few others."""

    bits: DataFrame
    power: int

    def keep(self, rows: DataFrame, key: Column, how: str = "left_semi") -> DataFrame:
        """The rows whose key (a hash, long) may be held; left_anti: those whose key is not."""
        place = F.shiftrightunsigned(key, 64 - self.power)
        byte = F.conv(F.hex(self.bits["bits"].substr((F.shiftright(place.bitwiseAND(F.lit(32767)), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        bit = F.pmod(place, F.lit(8)).cast("int")
        held = F.call_function("shiftright", byte, bit).bitwiseAND(F.lit(1)) == 1
        return rows.join(F.broadcast(self.bits), (F.shiftrightunsigned(place, 15) == self.bits["part"]) & held, how)


def key_filter(keys: DataFrame, column: str) -> KeyFilter:
    """A filter of the hashes in a column."""
    low, high = FILTER_POWERS
    power = min(max((keys.count() * FILTER_BITS).bit_length(), low), high)
    place = F.shiftrightunsigned(column, 64 - power)
    parts = keys.groupBy(F.shiftrightunsigned(place, 15).alias("part")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("bits"))
    return KeyFilter(parts, power)


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], n: str = "n", total: int | None = None) -> DataFrame:
    """rows joined with a table of one row a key, whose column n counts the rows of the key among `total` rows (if not given, those of `rows`).

    Keys with over one in HOT_SHARE of all rows, HOT_SHARE keys at most, are joined by broadcast, so no task gathers the rows of one. rows and table are read
    twice: both should be stored, or cheap to make.
    """
    bound = -(-(rows.count() if total is None else total) // HOT_SHARE)
    hot = F.broadcast(table.where(F.col(n) > bound))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(table.where(F.col(n) <= bound), keys)
    return rows.join(hot, keys).union(rest)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Return a worker's free memory to the system: Spark keeps workers for later stages, beside which it would stay."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_size(text: Column) -> Column:
    """UTF-8 bytes; null counts as none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches, rows: int = 1000):
    """The same rows in smaller batches, so that what a worker makes of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8; null has none."""
    return text.encode().split() if text else []
