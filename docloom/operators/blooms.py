"""A partitioned Bloom filter of keys, tested beside a scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.sources.sinks import stored

#: 64-bit words of one part, bits for each key, places of a key.
WORDS, BITS, PLACES = 1024, 10, 5
#: Keys up to which they are broadcast themselves (some 50 bytes each), and bytes of the filter that may be broadcast instead.
FEW_KEYS, MOST_BYTES = 1_000_000, 1 << 27


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _places(key: Column) -> list[Column]:
    """Bits of a key within its part, by double hashing."""
    h = F.xxhash64(key, F.lit(1))
    low, high = h.bitwiseAND(0x7FFFFFFF), F.shiftrightunsigned(h, 33).bitwiseOR(1)
    return [(low + i * high) % (WORDS * 64) for i in range(PLACES)]


def parts_for(n: int) -> int:
    return max(1, -(-n * BITS // (WORDS * 64)))


def bloom(keys: DataFrame, column: str, n: int) -> DataFrame:
    """(part, words): a filter for `n` keys, a row a part.  Every part is there, built by one task from its own keys' bits."""
    parts = parts_for(n)
    key = F.col(column)
    at = keys.where(key.isNotNull()).select(_part(key, parts).alias("part"), F.explode(F.array(*_places(key))).alias("at"))
    bits = at.select("part", F.floor(F.col("at") / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("at", F.lit(64)).cast("int")).alias("bits"))
    blank = keys.sparkSession.range(parts * WORDS).select(F.floor(F.col("id") / WORDS).cast("int").alias("part"), F.pmod("id", F.lit(WORDS)).cast("int").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = bits.unionByName(blank).groupBy("part", "word").agg(F.bit_or("bits").alias("bits"))
    row = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return words.groupBy("part").agg(F.transform(row, lambda w: w["bits"]).alias("words"))


def tested(df: DataFrame, column: str, found: DataFrame, n: int, name: str = "_maybe") -> DataFrame:
    """`df` with a flag: false where the key is surely not in the filter of `n` keys (also where it is null)."""
    key = F.col(column)
    sets = found.select(F.col("part").alias("_part"), F.col("words").alias("_words"))
    out = df.join(F.broadcast(sets), _part(key, parts_for(n)) == F.col("_part"))
    hit = [F.getbit(F.get("_words", F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1 for at in _places(key)]
    return out.select(*df.columns, (key.isNotNull() & reduce(Column.__and__, hit)).alias(name))


class KeySet:
    """A set of keys that tables are split by.

    Few keys are broadcast.  Of more, a filter is broadcast: rows that it doesn't know stay where they were read, and only those that may
    be in the set are moved and decided exactly.  Where even the filter would be larger than MOST_BYTES all rows are moved."""

    def __init__(self, keys: DataFrame, column: str):
        self.column = column
        self.keys = stored(keys.select(column).distinct())
        self.n = self.keys.count()
        self.filter = stored(bloom(self.keys, column, self.n)) if FEW_KEYS < self.n and parts_for(self.n) * WORDS * 8 <= MOST_BYTES else None

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows whose key isn't in the set, the others).  Null keys are in the first."""
        keys = F.broadcast(self.keys) if self.n <= FEW_KEYS else self.keys
        if self.filter is None:
            return df.join(keys, self.column, "left_anti").select(*df.columns), df.join(keys, self.column, "left_semi").select(*df.columns)
        flagged = tested(df, self.column, self.filter, self.n)
        sure, maybe = flagged.where("NOT _maybe").drop("_maybe"), flagged.where("_maybe").drop("_maybe")
        return sure.unionByName(maybe.join(keys, self.column, "left_anti").select(*df.columns)), maybe.join(keys, self.column, "left_semi").select(*df.columns)
