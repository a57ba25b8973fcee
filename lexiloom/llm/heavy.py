"""Problem 3: the most frequent values of a column, weighted, in memory that does not grow with the distinct values.

Rows are made distinct, summed within small batches (so a hot value leaves each task as a few rows) and hash-partitioned
by value. Each partition keeps a count-min sketch with conservative update and a bounded heap of its candidates; as no
value is in two partitions, the heaps are disjoint and their union is the merge. A sketch never counts too little, so
every heavy value is a candidate; an exact sum over the candidates alone takes out the others. The heap also reports
the largest estimate it let go: if that reaches the threshold, all values are summed exactly instead.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.terms import clean_rows
from lexiloom.plans.lineage import cut, spread_join, written
from lexiloom.sources.tables import tasks

#: Odd multipliers of the sketch's row hashes (multiply-shift over a 64-bit hash of the value); any odd numbers do.
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

#: Most candidates that go to every task for their exact sums.
MAX_CANDIDATES = 1_000_000


class Sketch:
    """Count-min sketch of ``len(ODD)`` rows and ``2 ** bits`` columns; takes batches of distinct values."""

    def __init__(self, bits: int) -> None:
        self.shift, self.cells = np.uint64(64 - bits), np.zeros((len(ODD), 1 << bits), np.int64)

    def add(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The estimates after the update. Only cells under the new estimate are raised, to it: none sinks below the
        true count of a value in it, also if two values of a batch meet in one."""
        at = [((hashes.view(np.uint64) * np.uint64(odd)) >> self.shift).astype(np.int64) for odd in ODD]
        now = np.minimum.reduce([row[i] for row, i in zip(self.cells, at)]) + weights
        for row, i in zip(self.cells, at):
            np.maximum.at(row, i, now)
        return now


def _combine(rows_a_block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            summed = pa.Table.from_batches(held).group_by("term").aggregate([("freq", "sum")])
            held.clear()
            yield from summed.rename_columns(["term", "freq"]).combine_chunks().to_batches()

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= rows_a_block:
                yield from out()
        if held:
            yield from out()

    return run


def _heaps(bits: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, heap, live, total, let_go = Sketch(bits), [], {}, 0, 0
        for b in batches:
            summed = pa.Table.from_batches([b]).group_by(["term", "h"]).aggregate([("freq", "sum")]).combine_chunks()
            weights = summed["freq_sum"].to_numpy()
            estimates = sketch.add(summed["h"].to_numpy(), weights)
            total += int(weights.sum())
            # below the smallest kept estimate a value can't enter a full heap
            least = heap[0][0] if len(live) >= capacity else -1
            for i in np.flatnonzero(estimates > least):
                term, now = summed["term"][int(i)].as_py(), int(estimates[i])
                live[term] = now
                heapq.heappush(heap, (now, term))
                while len(live) > capacity or heap and live.get(heap[0][1]) != heap[0][0]:
                    old, t = heapq.heappop(heap)
                    if live.get(t) == old:
                        del live[t]
                        let_go = max(let_go, old)
            if len(heap) > 4 * capacity:
                heap = sorted((now, t) for t, now in live.items())
            if least >= 0 and (under := estimates[estimates <= least]).size:
                let_go = max(let_go, int(under.max()))
        yield pa.RecordBatch.from_pydict({"term": [*live, None], "estimate": [*live.values(), let_go], "total": [*[0] * len(live), total]}, schema=pa.schema([("term", pa.string()), ("estimate", pa.int64()), ("total", pa.int64())]))

    return run


def heavy_hitters(rows: DataFrame, share: float = 1 / 500, bits: int = 16, capacity: int = 0, rows_a_block: int = 100_000) -> DataFrame:
    """(term, estimate, total) of each value whose exact total is at least ``share`` of the sum of all.

    ``rows``: row_id, term, freq (over 0); rows alike in all three count once. The heap of each partition holds
    ``capacity`` values (default 2 / share); a tie at the threshold is in. An empty table gives no rows.
    """
    single = rows.select("row_id", "term", F.col("freq").cast("bigint").alias("freq")).distinct().select("term", "freq")
    stream = written(single.mapInArrow(_combine(rows_a_block), "term string, freq bigint"))  # read twice
    parts = stream.select("term", "freq", F.xxhash64("term").alias("h")).repartition(tasks(stream), "h").mapInArrow(_heaps(bits, capacity or int(2 / share)), "term string, estimate bigint, total bigint")
    heaps = cut(parts)
    total, let_go = heaps.agg(F.sum("total"), F.max(F.when(F.col("term").isNull(), F.col("estimate")))).first()
    least = math.ceil(share * (total or 0) - 1e-6)
    heavy = heaps.where(F.col("term").isNotNull() & (F.col("estimate") >= F.lit(least)))
    if (let_go or 0) >= least and total:  # the heaps were too small for this column
        exact = stream.groupBy("term").agg(F.sum("freq").alias("total")).withColumn("estimate", F.col("total"))
    else:  # at most capacity values a partition
        exact = spread_join(stream, cut(heavy.select("term", "estimate")), ["term"], MAX_CANDIDATES).groupBy("term").agg(F.max("estimate").alias("estimate"), F.sum("freq").alias("total"))
    return exact.where(F.col("total") >= F.lit(least)).select("term", "estimate", "total")


def found(df: DataFrame) -> DataFrame:
    """(word) of word_freqs whose total is at least 1/500 of all."""
    return heavy_hitters(clean_rows(df)).select(F.col("term").alias("word"))
