"""Problem 5: held-out passages inside a corpus, by multi-pattern search over words.

Texts are read as sequences of words, so line ends and punctuation don't matter. The patterns are all windows of ``run``
words of the held-out items. As in Wu and Manber, a window slides over the text: the block of its last ``BLOCK`` words
is looked up in a shift table; a block that no pattern has moves the window on by nearly its length, one that stands
inside patterns only as far as the nearest could match. A shift of zero opens the bucket of the patterns that end with
this block, and all their words are compared with the window. The held-out items are the query set: they are taken in
blocks of bounded size, each a broadcast and one pass over the corpus; nothing of the corpus is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lexiloom.functions.text import WORD
from lexiloom.llm.blocks import in_blocks

BLOCK = 3
PAIRS = "item_id bigint, doc_id bigint"


class Patterns:
    """Shift and bucket tables of the windows of ``run`` words of ``items``, pairs of an id and its words."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int) -> None:
        self.run, self.block = run, min(BLOCK, run)
        self.shift: dict[tuple[str, ...], int] = {}
        self.buckets: dict[tuple[str, ...], dict[tuple[str, ...], set[int]]] = {}
        for item, words in items:
            for i in range(len(words) - run + 1):
                pattern = tuple(words[i : i + run])
                for end in range(self.block, run + 1):
                    block = pattern[end - self.block : end]
                    self.shift[block] = min(self.shift.get(block, run), run - end)
                self.buckets.setdefault(pattern[-self.block :], {}).setdefault(pattern, set()).add(item)

    def search(self, words: list[str]) -> set[int]:
        """The items of which a window stands in ``words``."""
        hits: set[int] = set()
        shift, block, run = self.shift.get, self.block, self.run
        far, n, end = run - block + 1, len(words), run
        while end <= n:
            tail = tuple(words[end - block : end])
            if step := shift(tail, far):
                end += step
                continue
            # a bucket finds its patterns by their hash and compares all their words
            if items := self.buckets.get(tail, {}).get(tuple(words[end - run : end])):
                hits |= items
            end += 1
        return hits


def _search(patterns: Broadcast):
    find = re.compile(WORD).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = patterns.value.search
        for b in batches:
            items, docs = [], []
            for doc, text in zip(b.column(0), b.column(1).to_pylist()):
                if text and (hits := search(find(text.lower()))):
                    items += hits
                    docs += [doc.as_py()] * len(hits)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(docs, pa.int64())], names=["item_id", "doc_id"])

    return run


def leaked(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, line: str, run: int = 12, max_words: int = 200_000) -> DataFrame:
    """(item_id, doc_id), distinct: at least ``run`` words in a row of the item stand in a row in the document.

    Null and empty texts and items under ``run`` words have no pair, null ids neither; repeated rows give their pair
    once; each of two like items has its pairs. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    corpus = docs.where(F.col(doc_id).isNotNull() & (F.length(text) >= 2 * run - 1)).select(F.col(doc_id).cast("bigint"), text)
    queries = items.where(F.col(item_id).isNotNull() & F.col(line).isNotNull()).select(F.col(item_id).cast("bigint").alias("item_id"), F.col(line).alias("text"))

    def search(block: list[Row]) -> tuple[DataFrame, Broadcast]:
        patterns = spark.sparkContext.broadcast(Patterns([(r.item_id, r.words) for r in block], run))
        return corpus.mapInArrow(_search(patterns), PAIRS), patterns

    pairs = in_blocks(queries, run, max_words, search)
    return spark.createDataFrame([], PAIRS) if pairs is None else pairs.distinct()


def found(books: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, book_id) of guten_test against gutenberg."""
    return leaked(books, "book_id", "text", items, "item_id", "line").withColumnRenamed("doc_id", "book_id")


def report(books: DataFrame, items: DataFrame) -> DataFrame:
    """(book_id, n_items, items): each book that holds a leaked passage, with the ids of its items in order."""
    hits = F.array_sort(F.collect_set("item_id"))
    return found(books, items).groupBy("book_id").agg(hits.alias("items")).select("book_id", F.size("items").alias("n_items"), "items")
