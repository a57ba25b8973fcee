"""Segmentation of words: merge replay, and the longest match by joins or by tries.

A model's merges and vocabulary are bounded by its size; they go to the tasks as literals or broadcasts. Texts are
segmented where they lie, in one pass of Arrow batches: a task segments each different word of a batch once and keeps
the pieces of the words it has met, so nothing is shuffled. The longest match by joins is the other way to the same
pieces, without Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import tokens as T
from lexiloom.functions.text import words
from lexiloom.plans.lineage import spread_join

#: More merges are replayed by a task's own table instead of an expression with all of them.
MAX_EXPRESSION = 200
#: Vocabularies up to so many tokens are broadcast for the join; a larger one is shuffled, over salts.
MAX_BROADCAST = 200_000


def replay(merges: list[tuple[str, str, str]], alphabet: list[str], end_marker: str | None = T.END):
    """A function from a word to its pieces (columns): characters outside ``alphabet`` are unknown, then all merges
    apply once each, in the order in which they were learned."""
    if not merges:
        raise ValueError("the tokenizer has no merges; train it first")
    known, table = F.lit(list(alphabet)), F.array(*[F.struct(F.lit(f"|{a}||{b}|").alias("f"), F.lit(f"|{m}|").alias("t")) for a, b, m in merges])

    def pieces(word: Column) -> Column:
        chars = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.when(F.array_contains(known, c), c).otherwise(T.UNK))
        start = F.concat(F.lit(""), F.array_join(F.transform(chars, lambda c: F.concat(F.lit("|"), c, F.lit("|"))), ""), F.lit(f"|{end_marker}|" if end_marker else ""))
        return T.tokens(F.aggregate(table, start, lambda acc, m: F.replace(acc, m.f, m.t)))

    return pieces


Ranks = dict[tuple[str, str], list[tuple[int, str]]]


def ranks_of(merges: list[tuple[str, str, str]]) -> Ranks:
    """All places in the order of learning, with the token made, of each pair; a pair may come again."""
    ranks: Ranks = {}
    for r, (a, b, m) in enumerate(merges):
        ranks.setdefault((a, b), []).append((r, m))
    return ranks


def replay_word(word: str, ranks: Ranks, known: set[str], end_marker: str | None) -> list[str]:
    """As :func:`replay`: the merge that ranks first behind the last one applied comes next, so each applies once."""
    split, last = [*(c if c in known else T.UNK for c in word), *([end_marker] if end_marker else [])], -1
    while True:
        ahead = [(r, p, m) for p in set(zip(split, split[1:])) for r, m in ranks.get(p, ()) if r > last]
        if not ahead:
            return split
        last, (a, b), m = min(ahead)
        split = T.merged_tokens(split, a, b, m)


class Replay:
    """Merge replay by a table of ranks, for models of any size."""

    def __init__(self, merges: list[tuple[str, str, str]], alphabet: list[str], end_marker: str | None = T.END) -> None:
        self.ranks, self.known, self.end = ranks_of(merges), set(alphabet), end_marker

    def pieces(self, word: str) -> list[str]:
        return replay_word(word, self.ranks, self.known, self.end)


def longest_match(distinct: DataFrame, vocab: DataFrame, kind: str = "bpe", end_marker: str | None = T.END) -> DataFrame:
    """(word, pieces): greedy longest match of each row of ``distinct`` (word), as joins and a fold.

    bpe: on the word and its end marker; a character that begins no token is unknown and one character long. wordpiece:
    in small letters, tokens behind the first character carry the continuation sign, tokens in square brackets match
    nothing, and a word with a gap is unknown as a whole. The empty word has no pieces but the marker's.
    """
    small = vocab.select("token").where(F.col("token").isNotNull() & (F.col("token") != "")).distinct()
    if kind == "wordpiece":
        small = small.where(~F.col("token").rlike(r"^\[.*\]$"))
    text = F.regexp_replace("token", f"^{T.CONT}", "") if kind == "wordpiece" else F.col("token")
    longest = small.agg(F.coalesce(F.max(F.length(text)), F.lit(0))).first()[0]
    whole = F.lower("word") if kind == "wordpiece" else F.concat("word", F.lit(end_marker or ""))
    base = distinct.select("word").where(F.col("word").isNotNull()).distinct()
    # partitioned by word once: the explodes, the broadcast join and the groups keep it so
    places = F.when(F.length("w") > 0, F.sequence(F.lit(1), F.greatest(F.length("w"), F.lit(1))))
    at = base.withColumn("w", whole).select("word", "w", F.explode_outer(places).alias("i"))
    room = F.sequence(F.lit(1), F.greatest(F.least(F.lit(longest), F.length("w") - F.col("i") + 1), F.lit(1)))
    cut = at.select("word", "i", "w", F.explode_outer(room).alias("n"))
    sub = F.expr("substring(w, i, n)")
    token = F.when(F.col("i") > 1, F.concat(F.lit(T.CONT), sub)).otherwise(sub) if kind == "wordpiece" else sub
    found = spread_join(cut.select("word", "i", "n", token.alias("token")), small.withColumn("hit", F.lit(True)), ["token"], MAX_BROADCAST, "left")
    matches = found.groupBy("word").agg(F.collect_list(F.when(F.col("hit"), F.struct("i", "n"))).alias("m")).withColumn("w", whole)
    at_each = F.when(F.length("w") > 0, F.sequence(F.lit(1), F.greatest(F.length("w"), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    best = F.transform(at_each, lambda i: F.coalesce(F.array_max(F.transform(F.filter("m", lambda x: x.i == i), lambda x: x.n)), F.lit(0)))
    matches = matches.select("word", "w", best.alias("best"))

    def step(acc: Column, n: Column) -> Column:
        piece = acc.w.substr(acc.i, F.greatest(n, F.lit(1)))
        if kind == "wordpiece":
            piece = F.when(acc.i > 1, F.concat(F.lit(T.CONT), piece)).otherwise(piece)
        else:
            piece = F.when(n == 0, T.UNK).otherwise(piece)
        here = acc.i == acc.p
        return F.struct(
            (acc.i + 1).alias("i"),
            F.when(here, acc.i + F.greatest(n, F.lit(1))).otherwise(acc.p).alias("p"),
            F.when(here, F.concat(acc.out, F.array(piece))).otherwise(acc.out).alias("out"),
            F.when(here & (n == 0), False).otherwise(acc.ok).alias("ok"),
            acc.w.alias("w"),
        )

    start = F.struct(F.lit(1).alias("i"), F.lit(1).alias("p"), F.array().cast("array<string>").alias("out"), F.lit(True).alias("ok"), F.col("w").alias("w"))
    done = matches.select("word", F.aggregate("best", start, step).alias("d"))
    pieces = F.when(F.col("d.ok"), F.col("d.out")).otherwise(F.array(F.lit(T.WP_UNK))) if kind == "wordpiece" else F.col("d.out")
    return done.select("word", pieces.alias("pieces"))


class Trie:
    """Tokens by their first characters, one trie for word starts and one for continuations."""

    def __init__(self, vocab: list[str], kind: str = "bpe", end_marker: str | None = T.END) -> None:
        self.kind, self.end = kind, end_marker or ""
        self.start: dict = {}
        self.inside: dict = {} if kind == "wordpiece" else self.start
        for token in vocab:
            if not token or kind == "wordpiece" and token[0] == "[" and token[-1] == "]":
                continue
            root, text = self.start, token
            if kind == "wordpiece" and token.startswith(T.CONT):
                root, text = self.inside, token[len(T.CONT) :]
            node = root
            for c in text:
                node = node.setdefault(c, {})
            if text:
                node[""] = token

    def pieces(self, word: str) -> list[str]:
        """One walk along the word; the deepest token on the way is the longest match."""
        text = word.lower() if self.kind == "wordpiece" else word + self.end
        out, i, n = [], 0, len(text)
        while i < n:
            node, token, j, k = self.inside if i else self.start, None, i, i
            while k < n and (node := node.get(text[k])) is not None:
                k += 1
                if "" in node:
                    token, j = node[""], k
            if token is None:
                if self.kind == "wordpiece":
                    return [T.WP_UNK]
                token, j = T.UNK, i + 1
            out.append(token)
            i = j
        return out


#: Words whose pieces a task keeps; when there are more it begins anew.
KEPT = 500_000


def pieces_of(rows: DataFrame, key: str, words: Column, make) -> DataFrame:
    """(key, pieces): array<array<string>>, the pieces of each word of the array ``words``, in one pass.

    ``make`` builds, once in each task, what gives a word's ``pieces``. Null words have null pieces, a null array too.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, met = make().pieces, {}
        for b in batches:
            lists = b.column(1)
            codes = lists.flatten().dictionary_encode()
            own = []
            for w in codes.dictionary.to_pylist():
                if w not in met:
                    met[w] = pieces(w)
                own.append(met[w])
            if len(met) > KEPT:
                met.clear()
            flat = pa.array(own, pa.list_(pa.string())).take(codes.indices)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32), mask=np.append(np.asarray(lists.is_null()), False))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, flat)], names=[key, "pieces"])

    return rows.select(key, words.alias("w")).mapInArrow(run, f"`{key}` {kind}, pieces array<array<string>>")


def _by_table(distinct: DataFrame, make) -> DataFrame:
    own = distinct.select("word").where(F.col("word").isNotNull()).distinct()
    return pieces_of(own, "word", F.array("word"), make).select("word", F.get("pieces", F.lit(0)).alias("pieces"))


def replay_rows(distinct: DataFrame, merges: list[tuple[str, str, str]], alphabet: list[str], end_marker: str | None = T.END) -> DataFrame:
    """(word, pieces) by merge replay with a table of the merges in each task, for vocabularies of any size."""
    shared = distinct.sparkSession.sparkContext.broadcast((list(merges), list(alphabet), end_marker))
    return _by_table(distinct, lambda: Replay(*shared.value))


def trie_match(distinct: DataFrame, vocab: list[str], kind: str = "bpe", end_marker: str | None = T.END) -> DataFrame:
    """(word, pieces): as :func:`longest_match`, by tries built once in each task. Null words are dropped."""
    shared = distinct.sparkSession.sparkContext.broadcast((list(vocab), kind, end_marker))
    return _by_table(distinct, lambda: Trie(*shared.value))


class Tokenizer:
    """A named way to segment words: bpe (merge replay), bpe_long and wpc (longest match), f_wpc (longest match by
    tries). ``vocab`` and ``merges`` are a trained model's lists."""

    KINDS = ("bpe", "bpe_long", "wpc", "f_wpc")

    def __init__(self, kind: str, vocab: list[str], merges: list[tuple[str, str, str]] | None = None, end_marker: str | None = T.END) -> None:
        if kind not in self.KINDS:
            raise ValueError(f"no tokenizer {kind!r}; there are {', '.join(self.KINDS)}")
        if not vocab:
            raise ValueError("the tokenizer has no vocabulary; train it first")
        self.kind, self.vocab, self.merges, self.end_marker = kind, list(vocab), list(merges or []), end_marker
        if kind == "bpe" and not self.merges:
            raise ValueError("the tokenizer has no merges; train it first")

    def _maker(self, spark: SparkSession):
        """What builds this tokenizer's table in a task."""
        if self.kind == "bpe":
            shared = spark.sparkContext.broadcast((self.merges, self.vocab, self.end_marker))
            return lambda: Replay(*shared.value)
        shared = spark.sparkContext.broadcast((self.vocab, "bpe" if self.kind == "bpe_long" else "wordpiece", self.end_marker))
        return lambda: Trie(*shared.value)

    def segment(self, distinct: DataFrame, joins: bool = False) -> DataFrame:
        """(word, pieces) of the different words of ``distinct`` (word). ``joins``: the longest match by joins."""
        own = distinct.select("word").where(F.col("word").isNotNull()).distinct()
        if self.kind == "bpe" and len(self.merges) <= MAX_EXPRESSION:
            return own.select("word", replay(self.merges, self.vocab, self.end_marker)(F.col("word")).alias("pieces"))
        if joins and self.kind in ("bpe_long", "wpc"):
            vocab = own.sparkSession.createDataFrame([(t,) for t in self.vocab], "token string")
            return longest_match(own, vocab, "wordpiece" if self.kind == "wpc" else "bpe", self.end_marker)
        return _by_table(own, self._maker(own.sparkSession))

    def texts(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, pieces): the pieces of each word of each text, array<array<string>>; null for a null text."""
        return pieces_of(docs.select(key, text), key, words(text), self._maker(docs.sparkSession))

    def surfaces(self, distinct: DataFrame) -> DataFrame:
        """(word, pieces) without markers, for scoring; words as they come, re-split into words first as in training.

        BPE pieces of a word with digits or hyphens are those of its parts; WordPiece takes it whole.
        """
        own = distinct.select("word").where(F.col("word").isNotNull()).distinct()
        parts = words("word") if self.kind.startswith("bpe") else F.array("word")
        done = pieces_of(own, "word", parts, self._maker(own.sparkSession))
        return done.select("word", T.plain(F.flatten("pieces")).alias("pieces"))


def tokenize_texts(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(doc_id, pos, piece_no, piece): each text's pieces. Null texts have none."""
    tokens = tokenizer.texts(docs).select("doc_id", F.posexplode("pieces").alias("pos", "own"))
    return tokens.select("doc_id", "pos", F.posexplode("own").alias("piece_no", "piece"))
