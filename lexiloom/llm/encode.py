"""Problem 6: ids of a byte-level BPE tokenizer, within the JVM.

A text is parted into words by the tokenizer's pattern. A word is the array of the ids of its bytes; a fold merges, as
often as there are bytes, the pair whose merge ranks first, keeping the ranks of all adjacent pairs beside the ids, so a
step looks up only the two new pairs. Long words, as of scripts without spaces, are parted first where the two bytes
stand side by side in no piece of the vocabulary: no merge can cross such a place. The rank map is one literal: the value of a one-row scalar subquery, an array of
small maps addressed by the pair's key, because a Spark map is searched from end to end. The most frequent distinct
words of the corpus are folded once and put into a second literal of bounded size (at most ``cached`` words of at most
``CACHED_CHARS`` characters); all other words are folded where they stand. So the texts are never shuffled, no word is
too rare or too long, and the cache changes the time, never the result.
"""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.plans.lineage import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# White space as the tokenizer has it, its pattern (letters first, as no other branch begins with them, and
# without ways back), and the bytes that its alphabet writes as themselves.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf" ?\p{{L}}++| ?\p{{N}}++|'(?:s|t|re|ve|m|ll|d)| ?[^{SPACE}\p{{L}}\p{{N}}]++|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
PLAIN_BYTES = ((33, 126), (161, 172), (174, 255))
#: No merge.
NONE = 2**31 - 1
#: Buckets of the rank literal and of the word literal; primes near a power of two.
RANK_BUCKETS, WORD_BUCKETS = 16381, 65521
CACHED_CHARS = 32
#: Parts of each class of counts, of which the last one that fits into the cache takes a part.
SLOTS = 64
#: Words of more bytes are parted before they are folded.
LONG = 40


def alphabet() -> list[str]:
    """The character that stands for each byte: itself if it is plain, else the next one from 256 on."""
    plain = {b for a, z in PLAIN_BYTES for b in range(a, z + 1)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary read from its JSON file on the driver."""

    def __init__(self, path: str = VOCABULARY) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        self.byte_ids = [ids[c] for c in alphabet()]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merged = [ids[a + b] for a, b in pairs]
        if merged != sorted(merged):
            raise ValueError("the merged ids of this vocabulary don't follow the ranks of its merges")
        self.merges = {(ids[a], ids[b]): m for (a, b), m in zip(pairs, merged)}
        byte = {c: b for b, c in enumerate(alphabet())}
        self.pieces = {i: bytes(byte[c] for c in t) for t, i in ids.items() if all(c in byte for c in t)}

    def ranks(self, spark: SparkSession) -> Column:
        """The rank literal: array<map<pair key, merged id>>; fixed by the vocabulary, about a megabyte."""
        buckets: dict[int, dict[int, int]] = defaultdict(dict)
        for (a, b), m in self.merges.items():
            key = a * 65536 + b
            buckets[key % RANK_BUCKETS][key] = m
        return spark.createDataFrame([([buckets.get(i, {}) for i in range(RANK_BUCKETS)],)], "ranks array<map<bigint,int>>").scalar()

    def inner(self, spark: SparkSession) -> Column:
        """array<boolean> by 256 * x + y: whether the bytes x, y stand side by side in a piece."""
        pairs = {256 * x + y for p in self.pieces.values() for x, y in zip(p, p[1:])}
        return spark.createDataFrame([([i in pairs for i in range(65536)],)], "inner array<boolean>").scalar()

    def tables(self, spark: SparkSession) -> dict[str, Column]:
        return {"ranks": self.ranks(spark), "inner": self.inner(spark), "bytes": F.lit(self.byte_ids)}


def words(text: Column | str) -> Column:
    """The pattern's words, which together are the text; null for a null text."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _rank(table: Column, a: Column, b: Column) -> Column:
    key = a.cast("bigint") * 65536 + b
    return F.coalesce(F.get(table, F.pmod(key, F.lit(RANK_BUCKETS)).cast("int"))[key], F.lit(NONE))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with(df: DataFrame, values: dict[str, Column], name: str, body) -> DataFrame:
    """``df`` with the column ``name`` as ``body`` has it from a struct of ``values``.

    Literals of subqueries can't be written inside a lambda, so they enter through a column; it is referred to once,
    and the optimizer puts both projections together: no row ever holds a table.
    """
    held = "lexiloom values"
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*kept, F.struct(*[v.alias(k) for k, v in values.items()]).alias(held)).select(*kept, _let(F.col(f"`{held}`"), body).alias(name))


def _fold(word: Column, tables: Column) -> Column:
    """The ids of one word; -1 stands at both ends of what is folded, so each pair has neighbours."""
    table, edge = tables.ranks, F.array(F.lit(-1))

    def start(ids: Column) -> Column:
        ranks = F.zip_with(ids, F.slice(ids, F.lit(2), F.size(ids)), lambda a, b: _rank(table, a, F.coalesce(b, F.lit(-1))))
        return F.struct(ids.alias("ids"), F.slice(ranks, F.lit(1), F.size(ids) - 1).alias("ranks"))

    def step(acc: Column, _: Column) -> Column:
        def merge(m: Column) -> Column:
            def at(p: Column) -> Column:
                left, right = F.get(acc.ids, p - 2), F.get(acc.ids, p + 1)
                ids = F.concat(F.slice(acc.ids, F.lit(1), p - 1), F.array(m), F.slice(acc.ids, p + 2, F.size(acc.ids)))
                ranks = F.concat(F.slice(acc.ranks, F.lit(1), p - 2), F.array(_rank(table, left, m), _rank(table, m, right)), F.slice(acc.ranks, p + 2, F.size(acc.ids)))
                return F.struct(ids.alias("ids"), ranks.alias("ranks"))

            return F.when(m == NONE, acc).otherwise(_let(F.array_position(acc.ranks, m).cast("int"), at))

        return _let(F.array_min(acc.ranks), merge)

    def run(ids: Column) -> Column:
        times = F.sequence(F.lit(1), F.greatest(F.size(ids) - 3, F.lit(1)))
        return F.aggregate(times, start(ids), step, lambda acc: F.slice(acc.ids, F.lit(2), F.size(acc.ids) - 2))

    def fold(raw: Column) -> Column:
        ids = F.transform(raw, lambda b: F.get(tables.bytes, b))
        return F.when(F.size(raw) == 1, ids).otherwise(_let(F.concat(edge, ids, edge), run))

    def parted(raw: Column) -> Column:
        n = F.size(raw)
        places = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: ~F.get(tables.inner, F.get(raw, i - 1) * 256 + F.get(raw, i)))
        bounds = _let(F.concat(F.array(F.lit(0)), places, F.array(n)), lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, z: F.slice(raw, a + 1, z - a)))
        return F.flatten(F.transform(bounds, fold))

    raw = F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), F.ascii)
    return _let(raw, lambda r: F.when(F.size(r) > LONG, parted(r)).otherwise(fold(r)))


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(WORD_BUCKETS)).cast("int")


def _cache(docs: DataFrame, text: str, vocabulary: Vocabulary, cached: int) -> Column:
    """The word literal: about the ``cached`` most frequent words of the corpus, and no more, with their ids, in buckets."""
    spark = docs.sparkSession
    counts = docs.select(F.explode(words(text)).alias("w")).where(F.length("w") <= CACHED_CHARS).groupBy("w").count()
    # no sort: words by classes of counts, each in some slots by a hash, and as many of the upper classes as there is room
    level = (F.floor(F.log2("count") * 16) * SLOTS + F.pmod(F.xxhash64("w"), F.lit(SLOTS))).alias("level")
    counts = written(counts.select("w", level))
    least, room = None, cached
    for row in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # some thousand rows at most
        if (room := room - row["count"]) < 0:
            break
        least = row["level"]
    top = counts.where(F.col("level") >= F.lit(least).cast("bigint")).select("w").repartition(spark.sparkContext.defaultParallelism, "w")
    folded = _with(top, vocabulary.tables(spark) | {"w": F.col("w")}, "ids", lambda t: _fold(t.w, t))
    buckets = folded.groupBy(_bucket(F.col("w")).alias("b")).agg(F.collect_list(F.struct("w", "ids")).alias("e"))
    every = spark.range(WORD_BUCKETS).select(F.col("id").cast("int").alias("b")).join(buckets, "b", "left")
    rows = F.array_sort(F.collect_list(F.struct("b", F.coalesce("e", F.array()).alias("e"))))
    return every.agg(F.transform(rows, lambda x: F.map_from_entries(x.e)).alias("words")).scalar()


def encode(docs: DataFrame, text: str = "text", vocabulary: Vocabulary | None = None, cached: int = 131_072, name: str = "ids") -> DataFrame:
    """``docs`` with the column ``name``: array<int>, the ids of the text without special tokens.

    Strings that look like special tokens are ordinary text. Null and empty texts have an empty array, never a null.
    All rows and columns stay.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or Vocabulary()
    values = vocabulary.tables(spark) | {"known": _cache(docs, text, vocabulary, cached), "parts": words(F.coalesce(text, F.lit("")))}
    return _with(docs, values, name, lambda t: F.flatten(F.transform(t.parts, lambda w: F.coalesce(F.get(t.known, _bucket(w))[w], _fold(w, t)))))


def decode(df: DataFrame, ids: str = "ids", vocabulary: Vocabulary | None = None, name: str = "text") -> DataFrame:
    """``df`` with the column ``name``: the pieces of the ids put together, as a string; a null array gives null.

    Ids outside the vocabulary add nothing.
    """
    spark, vocabulary = df.sparkSession, vocabulary or Vocabulary()
    hexes = [vocabulary.pieces.get(i, b"").hex() for i in range(max(vocabulary.pieces) + 1)]
    table = spark.createDataFrame([(hexes,)], "hexes array<string>").scalar()
    return _with(df, {"hexes": table, "ids": F.col(ids)}, name, lambda t: F.unhex(F.array_join(F.transform(t.ids, lambda i: F.coalesce(F.get(t.hexes, i), F.lit(""))), "")).cast("string"))


def encoded(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(doc_id, ids) of each row of documents."""
    return encode(docs.select("doc_id", "text"), vocabulary=vocabulary).select("doc_id", "ids")


def decoded(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(doc_id, text): the round trip of each text; null texts come back empty."""
    return decode(encoded(docs, vocabulary), vocabulary=vocabulary).select("doc_id", "text")
