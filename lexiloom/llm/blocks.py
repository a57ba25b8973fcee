"""Query sets taken in blocks: each block is sent to the tasks for one pass over the corpus, and only one block at a time
is with the driver."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lexiloom.functions.text import WORD
from lexiloom.plans.lineage import written


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find = re.compile(WORD).findall
    for b in batches:
        words = [find(t.lower()) for t in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(words, pa.list_(pa.string()))], names=[*b.schema.names[:-1], "words"])


def in_blocks(queries: DataFrame, min_words: int, max_words: int, search: Callable[[list[Row]], tuple[DataFrame, Broadcast]]) -> DataFrame | None:
    """The union of ``search`` over all blocks; None without queries.

    The last column of ``queries`` is their text, which must not be null; ``search`` gets rows with ``words`` in its place
    and gives a pass over the corpus and what it sends to the tasks. Rows of fewer than ``min_words`` words are left out.
    Rows go to blocks of about ``max_words`` words by a hash of all their columns. A single block is a lazy pass; of
    several, each is run, written and released before the next.
    """
    *others, text = queries.columns
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields[:-1]] + ["words array<string>"])
    rows = queries.mapInArrow(_worded, schema).where(F.size("words") >= min_words)
    rows = written(rows)
    blocks = -(-(rows.agg(F.sum(F.size("words"))).first()[0] or 0) // max_words)
    if blocks <= 1:
        held = rows.collect() if blocks else []
        return search(held)[0] if held else None
    parted, done = written(rows.withColumn("block", F.pmod(F.xxhash64(*rows.columns), F.lit(blocks)).cast("int")), "block"), []
    for k in range(blocks):
        if held := parted.where(F.col("block") == k).drop("block").collect():
            found, sent = search(held)
            done.append(written(found))
            sent.unpersist()
    return reduce(DataFrame.unionAll, done)
