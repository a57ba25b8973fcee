"""Counts and scores of adjacent token pairs over splits (sp, freq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.tokens import pairs, tokens


def pair_freq(splits: DataFrame) -> DataFrame:
    """(a, b, n): the frequency of each adjacent pair, counted at every place."""
    each = splits.select(F.explode(pairs(tokens(F.col("sp")))).alias("p"), "freq")
    return each.groupBy("p.a", "p.b").agg(F.sum("freq").alias("n"))


def symbol_freq(splits: DataFrame) -> DataFrame:
    """(tok, f): the frequency of each token."""
    return splits.select(F.explode(tokens(F.col("sp"))).alias("tok"), "freq").groupBy("tok").agg(F.sum("freq").alias("f"))


def pair_scores(splits: DataFrame, min_pair_freq: int = 1) -> DataFrame:
    """(a, b, n, score): n / (f(a) * f(b)) of the pairs with at least ``min_pair_freq``.

    The products are doubles, as two large counts don't fit a long. Spark picks the join by the sizes; both sides are
    already aggregated to symbols.
    """
    f = symbol_freq(splits)
    kept = pair_freq(splits).where(F.col("n") >= min_pair_freq)
    left, right = (f.select(F.col("tok").alias(c), F.col("f").alias(f"f{c}")) for c in ("a", "b"))
    score = F.col("n").cast("double") / (F.col("fa").cast("double") * F.col("fb").cast("double"))
    return kept.join(left, "a").join(right, "b").select("a", "b", "n", score.alias("score"))


def pair_score(splits: DataFrame, a: str, b: str, min_pair_freq: int = 1) -> DataFrame:
    """One row: the score of one pair, 0.0 if it is missing or below the threshold. Only splits with either token count."""
    near = splits.where(F.contains("sp", F.lit(f"|{a}|")) | F.contains("sp", F.lit(f"|{b}|")))
    found = pair_scores(near, min_pair_freq).where((F.col("a") == a) & (F.col("b") == b))
    return found.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
