"""Command line: prepare, train, tokenize, evaluate, compare, matrix and ambiguity over parquet tables (doc_id, text);
books are tables (book_id, text), the matrix' lines a table (row_id, text)."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.learn import fast_bpe, fast_wordpiece, learn, naive_bpe, wordpiece
from lexiloom.operators.segment import Tokenizer, tokenize_texts
from lexiloom.operators.words import rare_types, rarest_words, word_types
from lexiloom.plans import experiments as X
from lexiloom.plans import store
from lexiloom.sources import corpus as C

LEARNERS = {"bpe": fast_bpe, "naive_bpe": naive_bpe, "wpc": fast_wordpiece, "wpc_baseline": wordpiece}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexiloom", description=__doc__)
    sub = p.add_subparsers(dest="do", required=True)

    def command(name: str, *options: str) -> None:
        c = sub.add_parser(name)
        for o in options:
            flag, _, kind = o.partition(":")
            c.add_argument(f"--{flag}", type=int if kind == "int" else str, required=kind == "", default=None)

    command("prepare", "books", "out", "first:int", "subset:int")
    command("train", "learner", "docs", "models", "data", "size:int", "min-pair-freq:int")
    command("tokenize", "kind", "docs", "models", "data", "size:int", "out", "min-pair-freq:int")
    command("evaluate", "kind", "models", "data", "size:int", "gold", "docs", "wiki", "guten", "log", "min-pair-freq:int", "examples:str")
    command("compare", "kinds", "models", "data", "size:int", "docs", "log", "min-pair-freq:int")
    command("matrix", "lines", "books", "models", "gold", "wiki", "guten", "log")
    command("ambiguity", "docs", "size:int", "words:int")
    return p


def _evaluate(spark: SparkSession, a: argparse.Namespace, tokenizer: Tokenizer, docs: DataFrame, config: dict) -> DataFrame:
    lines = C.text_lines(spark, a.wiki).select(F.lit("wiki").alias("domain"), "text").unionByName(C.text_lines(spark, a.guten).select(F.lit("guten").alias("domain"), "text"))
    rare = rarest_words(rare_types(docs)).select("word")
    return X.evaluate(tokenizer, C.gold(C.gold_tsv(spark, a.gold)), X.ranked_types(docs, 10_000), rare, lines, config)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lexiloom").getOrCreate()
    least = getattr(a, "min_pair_freq", None)
    if a.do == "prepare":
        C.write_books(spark.read.parquet(a.books).select("book_id", "text").distinct(), "book_id", a.out, a.first or 1200, a.subset or 600)
        return
    if a.do == "matrix":
        lines, books = spark.read.parquet(a.lines), spark.read.parquet(a.books)
        X.run_matrix(spark, lambda data: X.training_corpus(data, lines, books), lambda t, d, c: C.append_log(_evaluate(spark, a, t, d, c), a.log), a.models)
        return
    docs = spark.read.parquet(a.docs)
    if a.do == "train":
        more = {"min_pair_freq": least or 1} if a.learner.startswith("wpc") else {}
        model = learn(word_types(docs), LEARNERS[a.learner](a.size, **more))
        store.save(model, spark, store.place(a.models, "bpe" if "bpe" in a.learner else "wpc", a.data, a.size, least))
    elif a.do == "tokenize":
        tokenizer = store.load(spark, store.place(a.models, a.kind, a.data, a.size, least), a.kind)
        tokenize_texts(docs, tokenizer).write.mode("overwrite").parquet(a.out)
    elif a.do == "evaluate":
        tokenizer = store.load(spark, store.place(a.models, a.kind, a.data, a.size, least), a.kind)
        config = {"type": a.kind, "train_data": a.data, "vocab_size": a.size, "min_pair_freq": None if a.kind.startswith("bpe") else least or 1}
        C.append_log(_evaluate(spark, a, tokenizer, docs, config), a.log)
        if a.examples:
            tokenizer.surfaces(spark.createDataFrame([(w,) for w in a.examples.split(",")], "word string")).show(truncate=False)
    elif a.do == "compare":
        pair = [store.load(spark, store.place(a.models, k, a.data, a.size, least), k) for k in a.kinds.split(",")]
        configs = tuple({"type": k, "train_data": a.data, "vocab_size": a.size, "min_pair_freq": None if k.startswith("bpe") else least or 1} for k in a.kinds.split(","))
        C.append_log(X.compare_run(*pair, X.ranked_types(docs, 10_000), configs), a.log)
    elif a.do == "ambiguity":
        rate, examples = X.ambiguity_report(word_types(docs), a.size or 1000, a.words or 2000)
        rate.show()
        examples.show(truncate=False)


if __name__ == "__main__":
    main()
