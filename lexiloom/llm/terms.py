"""Problem 2: frequency of every distinct term and n-gram, with the number of records it stands in.

The suffixes of all records, cut to n tokens, are range-partitioned and sorted. In this order the suffixes that share
their first n tokens, by the common prefix with the neighbour, are one interval for each n at once: its weights sum to
the n-gram's occurrences, and its length less the duplicates within records is its number of records. In a table of
texts a record is a row; the common prefix of each of its suffixes with the one before it in the record's own order says
for which n the place is a duplicate. In a table of words a record's rows lie anywhere, and every suffix is one token, so
the sort goes by (word, record, row) and duplicates are adjacent.

Range bounds go down to rows of one record, and equal suffixes of a batch of texts are one row with their number, so an
interval of any size spreads over many tasks. Only the intervals at the ends
of a partition, a few of each, can go on in another one; they alone are put together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.plans.lineage import written
from lexiloom.sources.tables import tasks

#: Between the tokens of a suffix: the lowest character, so suffixes with the same first tokens lie together. A token
#: must not have it.
GAP = "\0"
PARTS = "n int, term string, total bigint, records bigint, edge boolean, part int, lo bigint, hi bigint"


def clean_rows(df: DataFrame) -> DataFrame:
    """(row_id, chunk_id, term, freq) of the rows of word_freqs that count: the word, trimmed of spaces and tabs and in
    lower case, isn't empty and freq is over 0. Nulls in word or freq drop the row; a null chunk_id or row_id is kept."""
    rows = df.select("row_id", "chunk_id", F.lower(F.btrim("word", F.lit(" \t"))).alias("term"), "freq")
    return rows.where((F.col("term") != "") & (F.col("freq") > 0))


def _rows(n: int, names: pa.Array, totals, records, edges, lo: pa.Array | None = None, hi: pa.Array | None = None) -> pa.RecordBatch:
    size, part = len(names), TaskContext.get().partitionId()
    none = pa.nulls(size, pa.int64())
    columns = [pa.array(np.full(size, n, np.int32)), names.cast(pa.string()), pa.array(totals, pa.int64()), pa.array(records, pa.int64()), pa.array(edges, pa.bool_()), pa.array(np.full(size, part, np.int32))]
    return pa.RecordBatch.from_arrays([*columns, none if lo is None else lo, none if hi is None else hi], names=["n", "term", "total", "records", "edge", "part", "lo", "hi"])


class _Runs:
    """The intervals of one length over the sorted rows of a partition, batch by batch."""

    def __init__(self, n: int) -> None:
        self.n, self.held = n, None

    def add(self, names: pa.Array, at: np.ndarray, weight: np.ndarray, new: np.ndarray, record: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
        """Takes the sorted rows of a batch, whose runs begin at ``at``; gives the runs that are over, and holds the last."""
        starts = pa.array(at)
        names, totals, records = names.take(starts), np.add.reduceat(weight, at), np.add.reduceat(new.astype(np.int64), at)
        lo = hi = None
        if record is not None:
            lo, hi = record.take(starts), record.take(pa.array(np.append(at[1:], len(weight)) - 1))
        edge, low = self.held is None, lo and lo[0].as_py()
        if self.held:
            name, total, count, was_edge, was_low, _ = self.held
            if name == names[0].as_py():
                totals[0] += total
                records[0] += count
                edge, low = was_edge, was_low
            else:
                yield self._held()
        k = len(names) - 1
        if k:
            edges = np.zeros(k, bool)
            edges[0] = edge
            if lo is not None:
                lo = pa.concat_arrays([pa.array([low], pa.int64()), lo[1:]])
            yield _rows(self.n, names[:k], totals[:k], records[:k], edges, lo and lo[:k], hi and hi[:k])
        self.held = (names[k].as_py(), int(totals[k]), int(records[k]), edge if not k else False, low if not k else lo and lo[k].as_py(), hi and hi[k].as_py())

    def _held(self, end: bool = False) -> pa.RecordBatch:
        name, total, count, edge, low, high = self.held
        return _rows(self.n, pa.array([name]), [total], [count], [edge or end], *(pa.array([x], pa.int64()) for x in (low, high)))

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield self._held(True)


def _word_intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (term, record, key), with a weight: the intervals of single words. A row alike to the one before it
    in all three adds nothing; a null key never repeats another, a null record counts in the total alone."""
    runs, last = _Runs(1), None
    for b in batches:
        if not b.num_rows:
            continue
        term, record, key, weight = b.column("term"), b.column("record"), b.column("key"), np.asarray(b.column("weight"))

        def same(column: pa.Array, before) -> np.ndarray:
            out = np.empty(len(column), bool)
            out[0] = last is not None and column[0].as_py() is not None and column[0].as_py() == before
            out[1:] = np.asarray(pc.fill_null(pc.equal(column[1:], column[:-1]), False))
            return out

        own = same(term, last and last[0])
        again = own & same(record, last and last[1])
        repeated = own & same(key, last and last[2])
        repeated &= again | np.asarray(record.is_null())
        at = np.flatnonzero(np.append(True, ~own[1:]))
        yield from runs.add(term, at, np.where(repeated, 0, weight), ~again & np.asarray(record.is_valid()), record)
        last = tuple(c[len(c) - 1].as_py() for c in (term, record, key))
    yield from runs.end()


def _gram_intervals(max_n: int):
    """Sorted rows (suffix, again, weight) to the intervals of all n-grams up to ``max_n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, last = [_Runs(n) for n in range(1, max_n + 1)], None
        for b in batches:
            if not (rows := b.num_rows):
                continue
            # the last row of the batch before stands in front, so the first common prefix is known
            suffix = b.column("suffix") if last is None else pa.concat_arrays([last, b.column("suffix")])
            front = len(suffix) - rows
            parts = pc.split_pattern(suffix, GAP)
            start, length, flat = np.asarray(parts.offsets)[:-1], np.asarray(pc.list_value_length(parts)), parts.values
            again, weight = np.asarray(b.column("again")), np.asarray(b.column("weight"))
            common, names = np.ones(len(suffix) - 1, bool), None
            for n in range(1, max_n + 1):
                has = length >= n
                token = flat.take(pa.array(np.where(has, start + n - 1, 0), mask=~has))
                common &= np.asarray(pc.fill_null(pc.equal(token[1:], token[:-1]), False))
                names = token if names is None else pc.binary_join_element_wise(names, token, " ")
                own = np.flatnonzero(has[front:])
                if not own.size:
                    continue
                fresh = ~common[own - 1 + front] if front else np.append(True, ~common[own[1:] - 1]) if own[0] == 0 else ~common[own - 1]
                at = np.flatnonzero(np.append(True, fresh[1:]))
                yield from every[n - 1].add(names.take(pa.array(own + front)), at, weight[own], np.where(again[own] < n, weight[own], 0))
            last = suffix.slice(len(suffix) - 1)
        for runs in every:
            yield from runs.end()

    return run


def _suffixes(max_n: int):
    """Rows (tokens) to each place's suffix cut to ``max_n`` tokens, with how many of them it shares with the one before
    it in the order of this record's suffixes. Equal places of a batch are one row with their number, so a hot suffix
    leaves a task as a few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            flat = lists.flatten()
            total = len(flat)
            record = np.repeat(np.arange(len(sizes)), sizes)
            codes = np.asarray(flat.dictionary_encode().indices).astype(np.int64)
            columns, tokens = [], []
            for k in range(max_n):
                there = np.arange(total) + k
                inside = there < total
                there = np.where(inside, there, 0)
                inside &= record[there] == record if total else inside
                columns.append(np.where(inside, codes[there] if total else 0, -1))
                tokens.append(flat.take(pa.array(there, mask=~inside)))
            order = np.lexsort((*columns[::-1], record))
            shared, equal = np.zeros(total, np.int32), record[order][1:] == record[order][:-1]
            for c in columns:
                c = c[order]
                equal = equal & (c[1:] == c[:-1]) & (c[1:] >= 0)
                shared[order[1:]] += equal
            joined = pc.binary_join_element_wise(*tokens, GAP, null_handling="skip") if max_n > 1 else tokens[0]
            # in an order that has equal beginnings side by side: equal places become one row, and the shuffle packs well
            order = np.lexsort((shared, *columns[::-1]))
            fresh = np.ones(total, bool)
            fresh[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in (shared, *columns)]) if total > 1 else fresh[1:]
            at = np.flatnonzero(fresh)
            first = pa.array(order[at])
            yield pa.RecordBatch.from_arrays([joined.cast(pa.string()).take(first), pa.array(shared).take(first), pa.array(np.diff(np.append(at, total)), pa.int64())], names=["suffix", "again", "weight"])

    return run


def _whole(parts: DataFrame) -> DataFrame:
    """(n, term, total, records): intervals at the ends of partitions are put together. A record that goes on from one
    part to the next counts once."""
    parts = written(parts)
    edges = parts.where("edge").groupBy("n", "term").agg(F.sum("total").alias("total"), F.sum("records").alias("records"), F.array_sort(F.collect_list(F.struct("part", "lo", "hi"))).alias("p"))
    twice = F.aggregate(F.zip_with("p", F.slice("p", F.lit(2), F.size("p")), lambda x, y: F.coalesce((x.hi == y.lo).cast("bigint"), F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    return parts.where(~F.col("edge")).select("n", "term", "total", "records").unionAll(edges.select("n", "term", "total", F.col("records") - twice))


def term_counts(df: DataFrame) -> DataFrame:
    """(term, total, records) over rows as of :func:`clean_rows`; each row_id counts once for a word and chunk, rows
    without a row_id each for themselves, a null chunk in the total alone. An empty table gives no rows."""
    keyed = df.select("term", F.col("chunk_id").cast("bigint").alias("record"), F.col("row_id").cast("bigint").alias("key"), F.col("freq").cast("bigint").alias("weight"))
    order = ["term", "record", "key"]
    return _whole(keyed.repartitionByRange(tasks(keyed), *order).sortWithinPartitions(*order).mapInArrow(_word_intervals, PARTS)).select("term", "total", "records")


def ngram_counts(df: DataFrame, tokens: Column | str, max_n: int = 3) -> DataFrame:
    """(n, term, total, records) of all n-grams up to ``max_n`` of an array column, each row a record; an n-gram's tokens
    are parted by spaces. Null arrays and tokens have none, repeated rows are records of their own."""
    t = df.select(F.coalesce(F.filter(tokens, lambda x: x.isNotNull()), F.array().cast("array<string>")).alias("t"))
    rows = t.mapInArrow(_suffixes(max_n), "suffix string, again int, weight bigint")
    ordered = rows.repartitionByRange(tasks(rows), "suffix", "again").sortWithinPartitions("suffix")
    return _whole(ordered.mapInArrow(_gram_intervals(max_n), PARTS))


def marked_terms(df: DataFrame, rare_total: int = 5, rare_records: int = 1, common_share: float = 0.3) -> DataFrame:
    """(term, total, records, rare, common) of word_freqs.

    rare: a total under ``rare_total`` or at most ``rare_records`` chunks. common: in at least ``common_share`` of the
    distinct chunks of the rows that count. A word can be both; without any chunk none is common.
    """
    rows = clean_rows(df)
    chunks = rows.agg(F.count_distinct("chunk_id")).first()[0]
    return term_counts(rows).select("term", "total", "records", ((F.col("total") < rare_total) | (F.col("records") <= rare_records)).alias("rare"), ((F.col("records") > 0) & (F.col("records") >= F.lit(common_share * chunks - 1e-9))).alias("common"))


def found(df: DataFrame) -> DataFrame:
    """(word, mark) of each word too rare or too common; a word that is both has two rows."""
    marks = F.array_compact(F.array(F.when(F.col("rare"), "rare"), F.when(F.col("common"), "common")))
    return marked_terms(df).select(F.col("term").alias("word"), F.explode(marks).alias("mark"))
