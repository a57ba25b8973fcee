"""Reading corpora, word lists, vocabularies and gold segmentations; writing what the operators make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions.text import SPACE, stripped
from lexiloom.plans.lineage import written

# ---- sources


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, text) of text files, without white space at the lines' ends; ids grow in file order, with gaps."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_id"), F.rtrim("value", F.lit(SPACE)).alias("text"))


def corpus_lines(lines: DataFrame, order: str, max_lines: int | None = None, min_length: int = 10, drop_headings: bool = False) -> DataFrame:
    """(order, text): lines without outer white space that are at least ``min_length`` long, the first ``max_lines`` of
    them by ``order``. Null and blank lines don't count. ``drop_headings`` also leaves out lines within equals signs."""
    kept = lines.select(order, stripped("text").alias("text")).where((F.col("text") != "") & (F.length("text") >= min_length))
    if drop_headings:
        kept = kept.where(~F.col("text").rlike(r"^=.*=$"))
    return kept.orderBy(order).limit(max_lines) if max_lines is not None else kept


def first_books(books: DataFrame, order: str, first: int) -> DataFrame:
    """The first books by ``order``, of several texts of one book by the text."""
    return books.select(order, "text").orderBy(order, "text").limit(first)


def book_lines(books: DataFrame, order: str, first: int | None = None) -> DataFrame:
    """(order, line_no, text): the non-blank lines of the first books by ``order``, without outer white space."""
    some = first_books(books, order, first) if first is not None else books
    lines = some.select(order, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    return lines.select(order, "line_no", stripped("raw").alias("text")).where("text <> ''")


def word_counts_json(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq, first_doc, first_pos) of a JSON file with one object from words to counts, in the file's order."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,bigint>").alias("m"))
    return raw.select(F.posexplode("m").alias("first_pos", "word", "freq")).select("word", "freq", F.lit(0).cast("bigint").alias("first_doc"), "first_pos")


def ranked_words(spark: SparkSession, path: str) -> DataFrame:
    """(rank, word) of a text file, the rank is the line number from 0."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("rank", "word"))
    return lines.select("rank", stripped("word").alias("word")).where("word <> ''")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token) of a text file, one token a line."""
    return spark.read.text(path).select(stripped("value").alias("token")).where("token <> ''").distinct()


def merges(spark: SparkSession, path: str) -> DataFrame:
    """(rank, a, b, merged) written by :func:`write_merges`."""
    return spark.read.parquet(path)


def gold_surfaces(analyses: Column) -> Column:
    """The surfaces of the first analysis: what stands before each colon, but for empty ones and those with + or ~."""
    first = F.split(analyses, ",", 2)[0]
    surfaces = F.transform(F.split(first, r"\s+"), lambda x: F.split(x, ":", 2)[0])
    return F.filter(surfaces, lambda x: (x != "") & ~x.startswith("+") & ~x.startswith("~"))


def gold(rows: DataFrame) -> DataFrame:
    """(word, surfaces) of rows (line_no, word, analyses): words without a surface left are dropped, of several rows of a
    word the last one that is left counts. Null and empty words and null analyses are dropped."""
    parsed = rows.where(F.col("word") != "").select("word", "line_no", gold_surfaces(F.col("analyses")).alias("surfaces")).where(F.size("surfaces") > 0)
    return parsed.groupBy("word").agg(F.max(F.struct("line_no", "surfaces")).alias("last")).select("word", F.col("last.surfaces").alias("surfaces"))


def gold_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, word, analyses) of a file of tab-parted lines."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    parts = F.split("line", "\t", 2)
    return lines.select("line_no", F.get(parts, F.lit(0)).alias("word"), F.get(parts, F.lit(1)).alias("analyses"))


# ---- sinks


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """Text files of the non-blank lines, without outer white space; existing files are replaced."""
    df.select(stripped(column).alias("value")).where("value <> ''").write.mode("overwrite").text(path)


def write_splits(splits: dict[str, DataFrame], path: str) -> None:
    """One folder for each split, named split=..., of non-blank text lines."""
    for name, df in splits.items():
        write_lines(df, "text", f"{path}/split={name}")


def write_books(books: DataFrame, order: str, path: str, first: int = 1200, subset: int = 600) -> None:
    """The lines of the first books, and of a smaller number of them, as two text outputs of one reading. The window is
    over the first books alone."""
    some = written(first_books(books, order, first).withColumn("nth", F.row_number().over(W.orderBy(order, "text"))))
    write_lines(book_lines(some, order), "text", f"{path}/all")
    write_lines(book_lines(some.where(F.col("nth") <= subset), order), "text", f"{path}/subset")


def write_words(ranked: DataFrame, path: str) -> None:
    """One text file of the words of (rank, word), in order, for :func:`ranked_words`; a list bounded by its ranks."""
    ranked.orderBy("rank").coalesce(1).select(F.col("word").alias("value")).write.mode("overwrite").text(path)


def write_word_counts_json(types: DataFrame, path: str) -> None:
    """One text file with one JSON object from the words of (word, freq) to their counts, the most frequent first; for
    lists of bounded length, as it is one value."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("n"), "word", "freq")))
    entries = F.transform(pairs, lambda p: F.struct(p.word, p.freq))
    types.agg(F.to_json(F.map_from_entries(entries)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_word_counts(counts: DataFrame, path: str) -> None:
    """Text lines of count and word, most frequent first."""
    counts.orderBy(F.desc("freq"), "word").select(F.concat_ws(" ", "freq", "word").alias("value")).write.mode("overwrite").text(path)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """One sorted text file of tokens; a vocabulary is bounded by its size."""
    vocab.select("token").distinct().orderBy("token").coalesce(1).write.mode("overwrite").text(path)


def write_merges(model_merges: DataFrame, path: str) -> None:
    model_merges.write.mode("overwrite").parquet(path)


def write_examples(segmented: DataFrame, path: str) -> None:
    """CSV with header: word_type, wordpiece_subword_tokens (parted by spaces)."""
    segmented.select(F.col("word").alias("word_type"), F.array_join("pieces", " ").alias("wordpiece_subword_tokens")).write.mode("overwrite").csv(path, header=True)


def append_log(record: DataFrame, path: str) -> None:
    """JSON lines, added to those in the folder."""
    record.coalesce(1).write.mode("append").json(path)


def write_json(record: DataFrame, path: str) -> None:
    """One nested JSON record."""
    record.coalesce(1).write.mode("overwrite").json(path)
