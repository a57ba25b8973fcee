"""Metrics of segmentations; all take and give DataFrames, and all are 0 on empty input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import tokens as T
from lexiloom.functions.text import fertility_words


def ratio(x: Column, y: Column) -> Column:
    """x / y as double, 0.0 where y is 0 or null."""
    return F.when(y > 0, x.cast("double") / y.cast("double")).otherwise(F.lit(0.0))


def _sum(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0)).cast("bigint")


def _flags(pieces: Column) -> tuple[Column, Column, Column]:
    """Number of pieces; whether the word is unknown; whether it is one piece."""
    n = F.size(pieces)
    unknown = (n == 1) & (F.get(pieces, F.lit(0)) == T.WP_UNK)
    return n, unknown.cast("int"), (n == 1).cast("int")


def type_metrics(segmented: DataFrame) -> DataFrame:
    """Over types (word, pieces): n_types, n_pieces, avg_pieces, unk_rate, single_rate (unknown words count as single)
    and single_known_rate (they don't)."""
    n, unk, one = _flags(F.col("pieces"))
    s = segmented.agg(F.count("*").alias("n_types"), _sum(n).alias("n_pieces"), _sum(unk).alias("u"), _sum(one).alias("o"))
    total = F.col("n_types")
    return s.select("n_types", "n_pieces", ratio(F.col("n_pieces"), total).alias("avg_pieces"), ratio(F.col("u"), total).alias("unk_rate"), ratio(F.col("o"), total).alias("single_rate"), ratio(F.col("o") - F.col("u"), total).alias("single_known_rate"))


def text_metrics(freqs: DataFrame, segmented: DataFrame) -> DataFrame:
    """Over occurrences: (word, freq) joined with (word, pieces); n_tokens, n_pieces and the rates of type_metrics."""
    n, unk, one = _flags(F.col("pieces"))
    f = F.col("freq")
    s = freqs.join(segmented, "word").agg(_sum(f).alias("n_tokens"), _sum(f * n).alias("n_pieces"), _sum(f * unk).alias("u"), _sum(f * one).alias("o"))
    total = F.col("n_tokens")
    return s.select("n_tokens", "n_pieces", ratio(F.col("n_pieces"), total).alias("avg_pieces"), ratio(F.col("u"), total).alias("unk_rate"), ratio(F.col("o"), total).alias("single_rate"), ratio(F.col("o") - F.col("u"), total).alias("single_known_rate"))


def same_outputs(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n_words, n_different and same_outputs of two segmentations (word, pieces); a word of one alone differs."""
    both = a.select("word", F.col("pieces").alias("x")).join(b.select("word", F.col("pieces").alias("y")), "word", "full")
    s = both.agg(F.count("*").alias("n_words"), _sum((~F.col("x").eqNullSafe(F.col("y"))).cast("int")).alias("n_different"))
    return s.select("n_words", "n_different", (F.col("n_different") == 0).alias("same_outputs"))


def ambiguous(types: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(word, freq, standard, longest) of the types that two segmentations part differently."""
    both = types.join(a.select("word", F.col("pieces").alias("standard")), "word").join(b.select("word", F.col("pieces").alias("longest")), "word")
    return both.where(F.col("standard") != F.col("longest")).drop("first_doc", "first_pos")


def ambiguity_rate(types: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n_words, n_ambiguous, rate."""
    both = types.select("word").join(a.select("word", F.col("pieces").alias("x")), "word").join(b.select("word", F.col("pieces").alias("y")), "word")
    s = both.agg(F.count("*").alias("n_words"), _sum((F.col("x") != F.col("y")).cast("int")).alias("n_ambiguous"))
    return s.select("n_words", "n_ambiguous", ratio(F.col("n_ambiguous"), F.col("n_words")).alias("rate"))


def freq_words_metrics(ranked: DataFrame, segmented: DataFrame, band: int = 1000) -> DataFrame:
    """From (rank, word) with ranks from 0: avg_fertility_1k, avg_fertility_10k over the first ``band`` words and all, and
    how many different ones are kept whole, n_preserved_1k and n_preserved_10k."""
    rows = ranked.join(segmented, "word").select("word", (F.col("rank") < band).cast("int").alias("top"), F.size("pieces").alias("n"))
    whole = F.when(F.col("n") == 1, F.col("word"))
    s = rows.agg(_sum(F.col("top")).alias("k"), _sum(F.col("top") * F.col("n")).alias("kn"), F.count("*").alias("c"), _sum(F.col("n")).alias("cn"), F.count_distinct(F.when(F.col("top") == 1, whole)).alias("n_preserved_1k"), F.count_distinct(whole).alias("n_preserved_10k"))
    return s.select(ratio(F.col("kn"), F.col("k")).alias("avg_fertility_1k"), ratio(F.col("cn"), F.col("c")).alias("avg_fertility_10k"), "n_preserved_1k", "n_preserved_10k")


def mean_pieces(words: DataFrame, segmented: DataFrame) -> DataFrame:
    """One row: n_words, avg_fertility over the rows of ``words`` (word)."""
    s = words.select("word").join(segmented, "word").agg(F.count("*").alias("n_words"), _sum(F.size("pieces")).alias("p"))
    return s.select("n_words", ratio(F.col("p"), F.col("n_words")).alias("avg_fertility"))


def domain_fertility(lines: DataFrame, tokenizer) -> DataFrame:
    """(domain, n_words, n_pieces, fertility) of lines (domain, text): pieces for each run of letters, digits and
    underscores. ``tokenizer`` gives ``surfaces``."""
    counts = lines.select("domain", F.explode(fertility_words("text")).alias("word")).groupBy("domain", "word").agg(F.count("*").alias("c"))
    pieces = tokenizer.surfaces(counts.select("word")).select("word", F.size("pieces").alias("n"))
    s = counts.join(pieces, "word").groupBy("domain").agg(_sum(F.col("c")).alias("n_words"), _sum(F.col("c") * F.col("n")).alias("n_pieces"))
    return s.select("domain", "n_words", "n_pieces", ratio(F.col("n_pieces"), F.col("n_words")).alias("fertility"))


def in_out_domain(fertility: DataFrame, trained_on: str) -> DataFrame:
    """One row: in_domain and out_domain fertility for a corpus named wiki... or guten..., from rows of these domains."""
    own = next((d for d in ("wiki", "guten") if trained_on.startswith(d)), None)
    if own is None:
        raise ValueError(f"unknown domain: {trained_on}")
    other = "guten" if own == "wiki" else "wiki"
    pick = lambda d: F.coalesce(F.max(F.when(F.col("domain") == d, F.col("fertility"))), F.lit(0.0))
    return fertility.agg(pick(own).alias("in_domain"), pick(other).alias("out_domain"))


def boundary_vectors(segmented: DataFrame) -> DataFrame:
    """(word, vec): 0/1 for each inner position of the word."""
    return segmented.select("word", T.boundaries(F.col("pieces"), F.length("word")).alias("vec"))


def _overlap(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0), lambda acc, v: acc + v)


def _ones(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda acc, v: acc + v)


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = (df.select("word", F.size("pieces").alias(n), T.boundaries(F.col("pieces"), F.length("word")).alias(v)) for df, n, v in ((a, "na", "x"), (b, "nb", "y")))
    rows = x.join(y, "word").select("word", "na", "nb", F.size("x").alias("n"), _ones(F.col("x")).alias("sx"), _ones(F.col("y")).alias("sy"), _overlap(F.col("x"), F.col("y")).alias("i"))
    return rows.withColumn("f1", ratio(2 * F.col("i"), F.col("sx") + F.col("sy")))


def gold_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: precision, recall, f1 over all boundaries of gold (word, surfaces), avg_spw_pred, avg_spw_gold and
    per_word_f1, the mean of the words' scores, 0 for words in which neither side has a boundary. A gold word without a
    prediction counts as one piece."""
    pred = gold.select("word").join(predicted, "word", "left").select("word", F.coalesce("pieces", F.array("word")).alias("pieces"))
    rows = _pairs(gold.select("word", F.col("surfaces").alias("pieces")), pred)
    s = rows.agg(F.count("*").alias("w"), _sum(F.col("na")).alias("ng"), _sum(F.col("nb")).alias("np"), _sum(F.col("sx")).alias("g"), _sum(F.col("sy")).alias("p"), _sum(F.col("i")).alias("i"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("per_word_f1"))
    return s.select(ratio(F.col("i"), F.col("p")).alias("precision"), ratio(F.col("i"), F.col("g")).alias("recall"), ratio(2 * F.col("i"), F.col("p") + F.col("g")).alias("f1"), ratio(F.col("np"), F.col("w")).alias("avg_spw_pred"), ratio(F.col("ng"), F.col("w")).alias("avg_spw_gold"), F.round("per_word_f1", 9).alias("per_word_f1"))


def kappa(n: Column, sx: Column, sy: Column, i: Column) -> Column:
    """Cohen's kappa of two 0/1 vectors from their length, sums and common ones; null where it isn't defined."""
    n01_10 = sx + sy - 2 * i
    chance = (n - sx) * sy + sx * (n - sy)
    return F.when(chance > 0, 1 - (n01_10 * n).cast("double") / chance.cast("double"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: kappa and f1 over all boundaries of two segmentations, and the means per_word_kappa, per_word_f1.

    The kappa of a word in which one side is constant is 1 if both are equal, else 0; words of one side alone don't count.
    """
    rows = _pairs(a, b)
    n, sx, sy, i = (F.col(c).cast("bigint") for c in ("n", "sx", "sy", "i"))
    varied = (sx > 0) & (sx < n) & (sy > 0) & (sy < n)
    own = F.when(varied, kappa(n, sx, sy, i)).otherwise(F.when((sx == sy) & (sx == i), 1.0).otherwise(0.0))
    s = rows.withColumn("k", own).agg(_sum(n).alias("n"), _sum(sx).alias("sx"), _sum(sy).alias("sy"), _sum(i).alias("i"), F.coalesce(F.avg("k"), F.lit(0.0)).alias("per_word_kappa"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("per_word_f1"))
    return s.select(kappa(F.col("n"), F.col("sx"), F.col("sy"), F.col("i")).alias("kappa"), ratio(2 * F.col("i"), F.col("sx") + F.col("sy")).alias("f1"), F.round("per_word_kappa", 9).alias("per_word_kappa"), F.round("per_word_f1", 9).alias("per_word_f1"))
