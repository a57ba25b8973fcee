"""Word counts and segmentation over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import words
from lexiloom.operators.segment import replay


def word_counts(stream: DataFrame) -> DataFrame:
    """(word, freq) of a stream with a column text; a stateful aggregation, to be written in update or complete mode."""
    return stream.select(F.explode(words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


def windowed_word_counts(stream: DataFrame, at: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, word, freq): counts by windows of event time; rows later than ``late`` are dropped with the state."""
    rows = stream.withWatermark(at, late).select(at, F.explode(words("text")).alias("word"))
    return rows.groupBy(F.window(at, window).alias("w"), "word").agg(F.count("*").alias("freq")).select(F.col("w.start").alias("start"), "word", "freq")


def tokenized(stream: DataFrame, merges: list[tuple[str, str, str]], alphabet: list[str]) -> DataFrame:
    """The stream with the column pieces: the pieces of all words of its text by merge replay; no state."""
    pieces = replay(merges, alphabet)
    return stream.withColumn("pieces", F.flatten(F.transform(F.coalesce(words("text"), F.array().cast("array<string>")), pieces)))
