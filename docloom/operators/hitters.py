"""The most frequent values, exactly, without moving the rest: summaries first, then a count of what may be among them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources.sinks import stored

#: Values that a task's summary holds at first, how much larger each further one is, and the largest.
CAPACITY, GROWTH, LARGEST = 1 << 10, 16, 1 << 18
#: Bytes of candidates that may be broadcast.
SMALL = 1 << 26


def summarise(held: dict[str, int], most: int) -> int:
    """Cuts a summary down to `most` values: what the first one beyond them counts is taken from all.  Returns that count."""
    if len(held) <= most:
        return 0
    cut = sorted(held.values(), reverse=True)[most]
    for v in [v for v, n in held.items() if n <= cut]:
        del held[v]
    for v in held:
        held[v] -= cut
    return cut


def _summaries(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lost = {}, 0
        for batch in batches:
            for v, n in zip(*pc.value_counts(batch.column(0)).flatten(), strict=True):
                v, n = v.as_py(), n.as_py()
                if v is not None:
                    held[v] = held.get(v, 0) + n
            if len(held) > 4 * most:
                lost += summarise(held, most)
        lost += summarise(held, most)
        # a null value tells what any value may have lost
        yield pa.RecordBatch.from_arrays([pa.array([None, *held], pa.string()), pa.array([lost, *held.values()], pa.int64())], names=["value", "n"])

    return run


def candidates(df: DataFrame, column: str, n: int, most: int) -> tuple[DataFrame, int]:
    """(value), lost: every value that more than `lost` rows have is among the candidates.

    A summary never counts too much, and too little by what it lost at most; what the tasks lost is summed.  Of the values in the
    summaries those stay that may be among the n most frequent."""
    parts = stored(df.select(F.col(column).cast("string").alias("value")).mapInArrow(_summaries(most), "value string, n bigint"))
    lost = parts.where("value IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sums = stored(parts.where("value IS NOT NULL").groupBy("value").agg(F.sum("n").alias("n")))
    last = [r.n for r in sums.orderBy(F.desc("n")).select("n").limit(n).collect()]
    least = last[-1] - lost if len(last) == n else 0
    return sums.where(F.col("n") >= least).select("value"), lost


def most_frequent(df: DataFrame, column: str, n: int, capacity: int = CAPACITY) -> DataFrame | None:
    """(value), a superset of the n most frequent values that are not null, whatever breaks their ties; null where summaries can't
    tell.

    A first pass makes a summary of `capacity` values in each task; if the n-th of its candidates isn't more frequent than what
    the summaries may have lost, it is made again with more."""
    rows = F.col(column).cast("string")
    while capacity <= LARGEST:
        found, lost = candidates(df, column, n, capacity)
        if lost == 0:
            return found
        small = (found.agg(F.sum(F.octet_length("value").cast("long") + 64)).first()[0] or 0) <= SMALL
        counted = df.select(rows.alias("value")).join(F.broadcast(found) if small else found, "value", "left_semi").groupBy("value").agg(F.count(F.lit(1)).alias("count"))
        last = [r["count"] for r in counted.orderBy(F.desc("count")).select("count").limit(n).collect()]
        if len(last) == n and last[-1] > lost:
            return found
        capacity *= GROWTH
    return None
