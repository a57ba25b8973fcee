"""Word tokens and word types of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import fertility_words, rare_words, words
from lexiloom.functions.tokens import tokens
from lexiloom.plans.lineage import one_row


def word_tokens(docs: DataFrame, tokenizer=words) -> DataFrame:
    """(doc_id, pos, word): each word of each text in order, pos from 0; null texts have none."""
    return docs.select("doc_id", F.posexplode(tokenizer(F.col("text"))).alias("pos", "word"))


def word_types(docs: DataFrame, tokenizer=words) -> DataFrame:
    """(word, freq, first_doc, first_pos): counts with the first place of each word, which settles ties in corpus order.

    Words are summed within each task before the shuffle, so a hot word is one row of each.
    """
    first = F.min(F.struct("doc_id", "pos"))
    types = word_tokens(docs, tokenizer).groupBy("word").agg(F.count("*").alias("freq"), first.alias("at"))
    return types.select("word", "freq", F.col("at.doc_id").alias("first_doc"), F.col("at.pos").alias("first_pos"))


def word_freq(docs: DataFrame, tokenizer=words) -> DataFrame:
    """(word, freq)."""
    return word_tokens(docs, tokenizer).groupBy("word").agg(F.count("*").alias("freq"))


def top_words(types: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent types, ties in corpus order; all of them if ``n`` is 0 or less."""
    return types.orderBy(F.desc("freq"), "first_doc", "first_pos").limit(n) if n > 0 else types


def rarest_words(types: DataFrame, n: int = 1000) -> DataFrame:
    """The ``n`` rarest types; of equally rare ones the last seen come first."""
    return types.orderBy("freq", F.desc("first_doc"), F.desc("first_pos")).limit(n)


def rare_types(docs: DataFrame) -> DataFrame:
    """Types by the rare-word pattern."""
    return word_types(docs, rare_words)


def first_tokens(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, pos, word): the first ``n`` tokens of the corpus; all of them if ``n`` is 0 or less."""
    rows = word_tokens(docs)
    return rows.orderBy("doc_id", "pos").limit(n) if n > 0 else rows


def fertility_tokens(docs: DataFrame) -> DataFrame:
    """(word, n): words as fertility counts them, with case, digits and underscores."""
    return docs.select(F.explode(fertility_words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: lines (texts that aren't null), types and tokens; zeros for an empty corpus."""
    counts = word_freq(docs).agg(F.count("*").alias("types"), F.coalesce(F.sum("freq"), F.lit(0)).alias("tokens"))
    row = one_row(docs.sparkSession, {"l": docs.agg(F.count("text").alias("lines")), "c": counts})
    return row.select("l.lines", "c.types", "c.tokens")


def alphabet(types: DataFrame, split) -> DataFrame:
    """(symbol): the distinct tokens of the initial splits, sorted."""
    return types.select(F.explode(tokens(split(F.col("word")))).alias("symbol")).distinct().orderBy("symbol")
