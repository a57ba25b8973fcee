"""Problem 1: lines that a source repeats over its documents, by distributed PrefixSpan.

A document is the sequence of its lines that are frequent in its source; all other lines leave the database at once. The
lines are made once and written. Their documents are counted by (line, document) first, so a line of every document of
the largest source is no hot group, and the frequent lines, some thousands for each source, are joined to all lines as a
broadcast behind a check of their number, else spread over salts.

A prefix of k lines has a projected database: of each document with the prefix, what follows. Level one has a prefix for
each frequent line. A projected database of at most ``MAX_LOAD`` lines is mined to its end in one task, depth first; a
larger one, as of a line that a third of all documents has, is extended by one line as a distributed table, and its
longer prefixes are looked at in the same way. Both ways give the same sequences. Growth ends where nothing is frequent.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import stripped
from lexiloom.plans.lineage import cut, spread_join, written

#: Most frequent lines that go to every task (about 40 bytes each), and the most lines of a database that one task mines.
MAX_LINES, MAX_LOAD = 500_000, 200_000

FOUND = ["source", "prefix", "book_id", "places", "nos", "seq"]
PATTERNS = "source string, prefix binary, books bigint, places bigint, book_id bigint, start_no int, end_no int"


def source_key(source: Column | str) -> Column:
    """A source trimmed and in lower case; a blank one is null."""
    key = F.lower(stripped(source))
    return F.when(key != "", key)


def lines(books: DataFrame, min_chars: int = 10) -> DataFrame:
    """(source, book_id, text_id, line_no, line): the identified lines that can count.

    line_no counts from 0 over the text parted at newlines. Lines agree if their letters do, in lower case; ``line`` is
    the MD5 of these letters, as 64 bits would collide among the lines of a large corpus. Lines under ``min_chars``
    characters once trimmed, without a letter, of a null or blank source, a null book_id or text have no row. text_id
    tells apart the texts of one book_id.
    """
    rows = books.select(source_key("source").alias("source"), F.col("book_id").cast("bigint").alias("book_id"), "text", F.xxhash64("text").alias("text_id"))
    at = rows.where(F.col("source").isNotNull() & F.col("book_id").isNotNull()).select("source", "book_id", "text_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    at = at.where(F.length("raw") >= min_chars)
    at = at.select("source", "book_id", "text_id", "line_no", F.length(stripped("raw")).alias("n"), F.lower(F.regexp_replace("raw", r"[^\p{L}]+", "")).alias("letters"))
    return at.where((F.col("n") >= min_chars) & (F.col("letters") != "")).select("source", "book_id", "text_id", "line_no", F.unhex(F.md5("letters")).alias("line"))


def frequent_lines(books: DataFrame, min_books: int = 5) -> DataFrame:
    """(source, book_id, text_id, line_no, line): all places of the lines that at least ``min_books`` documents of the
    source have. A row that returns gives its places again."""
    at = written(lines(books))
    often = at.select("source", "line", "book_id").distinct().groupBy("source", "line").agg(F.count("*").alias("n"))
    return spread_join(at, cut(often.where(F.col("n") >= min_books).select("source", "line")), ["source", "line"], MAX_LINES)


def _extend(seq: list[bytes], nos: list[int], places: list[tuple[int, int]], max_gap: int | None) -> dict[bytes, list[tuple[int, int]]]:
    """The places (index of the first line, index of the last) of each next line behind ``places`` in one document."""
    at: dict[bytes, list[int]] = defaultdict(list)
    for i in range(min(e for _, e in places) + 1, len(seq)):
        at[seq[i]].append(i)
    out = {}
    for x, where in at.items():
        new = []
        for s, e in places:
            k = bisect_right(where, e)
            if max_gap is None:  # a later place of the same line has a shorter suffix and adds nothing
                new += [(s, where[k])] if k < len(where) else []
            else:
                while k < len(where) and nos[where[k]] - nos[e] <= max_gap:
                    new.append((s, where[k]))
                    k += 1
        if new:
            out[x] = sorted(set(new))
    return out


def _mine(docs: list[tuple], prefix: bytes, min_books: int, longest: int | None, max_gap: int | None) -> Iterator[tuple]:
    """(prefix, books, places, first place) of all frequent sequences that begin with ``prefix`` and are longer.

    ``docs``: (book_id, seq, nos, places) of each document with the prefix.
    """
    open_ = [(prefix, [(d, p) for d, (*_, p) in enumerate(docs)])]
    while open_:
        prefix, rows = open_.pop()
        if longest is not None and len(prefix) // 16 >= longest:
            continue
        longer: dict[bytes, list] = defaultdict(list)
        for d, places in rows:
            _, seq, nos, _ = docs[d]
            for x, new in _extend(seq, nos, places, max_gap).items():
                longer[x].append((d, new))
        for x, own in longer.items():
            if (n := len({docs[d][0] for d, _ in own})) >= min_books:
                first = min((docs[d][0], docs[d][2][s], docs[d][2][e]) for d, new in own for s, e in new)
                yield (prefix + x, n, sum(len(new) for _, new in own), *first)
                open_.append((prefix + x, own))


def _pairs(places: list[dict]) -> list[tuple[int, int]]:
    return [(p["s"], p["e"]) for p in places]


def _mined(min_books: int, longest: int | None, max_gap: int | None):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        docs = [(b, seq, nos, _pairs(p)) for b, seq, nos, p in zip(*(group[c].to_pylist() for c in ("book_id", "seq", "nos", "places")))]
        source, prefix = (k.as_py() for k in key)
        out = [(source, *row) for row in _mine(docs, prefix, min_books, longest, max_gap)]
        columns = list(zip(*out)) or [()] * 7
        kinds = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["source", "prefix", "books", "places", "book_id", "start_no", "end_no"])

    return run


def _longer(max_gap: int | None, schema: pa.Schema):
    """Each row of a level to a row for each next line of its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                for x, new in _extend(row["seq"], row["nos"], _pairs(row["places"]), max_gap).items():
                    out.append({**row, "prefix": row["prefix"] + x, "places": [{"s": s, "e": e} for s, e in new]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


LEVEL = pa.schema([("source", pa.string()), ("prefix", pa.binary()), ("book_id", pa.int64()), ("places", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), ("nos", pa.list_(pa.int32())), ("seq", pa.list_(pa.binary()))])


def prefix_span(books: DataFrame, min_books: int = 5, max_lines: int | None = None, max_gap: int | None = None, max_load: int = MAX_LOAD) -> DataFrame:
    """(source, prefix, lines, books, places, book_id, start_no, end_no): every frequent sequence; prefix has the
    identifiers of its lines, the last columns are its first place.

    A sequence is frequent if its lines stand in this order in at least ``min_books`` different documents of its source,
    whatever stands between them. ``places`` counts the places where it can begin. Growth ends when no sequence is
    frequent. ``max_lines`` bounds the lines of a sequence and ``max_gap`` the line numbers from a line to the next one;
    with a gap the next line may be any place of it, and each way counts as a place. A row that repeats a document adds
    nothing; two texts of one book_id are two sequences and one document. Without documents there are no rows.
    """
    # the lines of one document that survive, a few of its rows
    docs = frequent_lines(books, min_books).groupBy("source", "book_id", "text_id").agg(F.array_sort(F.collect_set(F.struct("line_no", "line"))).alias("s"))
    docs = written(docs.select("source", "book_id", F.col("s.line_no").alias("nos"), F.col("s.line").alias("seq")))
    each = docs.select("source", F.explode(F.array_distinct("seq")).alias("prefix"), "book_id", "nos", "seq")
    all_at = F.filter(F.transform("seq", lambda y, i: F.when(y == F.col("prefix"), F.struct(i.alias("s"), i.alias("e")))), lambda p: p.isNotNull())
    level, found, depth, large = each.withColumn("places", all_at).select(FOUND), [], 1, None
    while True:
        left = F.greatest(F.size("seq") - F.element_at("places.e", 1) - 1, F.lit(0))
        place = F.struct("book_id", F.get("nos", F.get("places.s", F.lit(0))).alias("start_no"), F.get("nos", F.get("places.e", F.lit(0))).alias("end_no"))
        by_book = level.groupBy("source", "prefix", "book_id").agg(F.sum(F.size("places")).alias("places"), F.sum(left).alias("load"), F.min(place).alias("at"))
        stats = by_book.groupBy("source", "prefix").agg(F.count("*").alias("books"), F.sum("places").alias("places"), F.sum("load").alias("load"), F.min("at").alias("at"))
        stats = written(stats.where(F.col("books") >= min_books))
        found.append(stats.select("source", "prefix", "books", "places", "at.*"))
        if max_lines is not None and depth >= max_lines:
            break
        large = stats.where(F.col("load") > max_load).select("source", "prefix")
        any_large = not large.isEmpty()
        small = spread_join(level.where(left > 0), large, ["source", "prefix"], MAX_LINES, "left_anti") if any_large else level.where(left > 0)
        found.append(small.groupBy("source", "prefix").applyInArrow(_mined(min_books, max_lines, max_gap), PATTERNS))
        if not any_large:
            break
        more = spread_join(level.where(left > 0), large, ["source", "prefix"], MAX_LINES, "left_semi").select(FOUND)
        level, depth = written(more.mapInArrow(_longer(max_gap, LEVEL), more.schema)), depth + 1
    out = found[0]
    for part in found[1:]:
        out = out.unionAll(part)
    return out.select("source", "prefix", (F.octet_length("prefix") / 16).cast("int").alias("lines"), "books", "places", "book_id", "start_no", "end_no")


def found(books: DataFrame) -> DataFrame:
    """(book_id, line_no) of each line of a frequent sequence of at least 5 documents. Each line of such a sequence is one
    itself, so these are the places of PrefixSpan's first level: its growth can add none."""
    return frequent_lines(books).select("book_id", F.col("line_no").cast("bigint").alias("line_no")).distinct()


def sequences(books: DataFrame) -> DataFrame:
    """(source, pattern, lines, books, places, book_id, start_no, end_no): the frequent sequences; pattern is the MD5 of
    the identifiers."""
    return prefix_span(books).withColumn("pattern", F.md5("prefix")).select("source", "pattern", "lines", "books", "places", "book_id", "start_no", "end_no")


def cleaned(books: DataFrame) -> DataFrame:
    """(book_id, text): each different text of a book and source without the found lines; a null text stays null.

    The lines found in one text of a book_id are cut out of this text alone. A null book_id or source has none found.
    """
    key = ["book_id", "source", "text_id"]
    rows = books.select(F.col("book_id").cast("bigint").alias("book_id"), source_key("source").alias("source"), "text", F.xxhash64("text").alias("text_id"))
    marks = frequent_lines(books).groupBy(*key).agg(F.collect_set("line_no").alias("drop"))
    # both sides lie by the same key: the texts move once
    rows = rows.dropDuplicates(key).join(marks, key, "left")
    kept = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(~F.array_contains("drop", i), x)), lambda x: x.isNotNull())
    return rows.select("book_id", F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
