"""Whole runs: train, segment, evaluate, compare, and the grid of configurations."""

from __future__ import annotations

import time
from itertools import groupby, product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.operators import metrics as M
from lexiloom.operators.learn import Learner, Model, fast_bpe, fast_wordpiece, learn, learn_distributed, wordpiece
from lexiloom.operators.segment import Tokenizer, trie_match
from lexiloom.operators.words import corpus_stats, first_tokens, top_words, word_freq, word_types
from lexiloom.plans import store
from lexiloom.plans.lineage import one_row, written
from lexiloom.sources import corpus as C

# The evaluation grid.
TYPES, CORPORA, SIZES, THRESHOLDS = ("bpe", "wpc"), ("wiki", "guten600", "guten1k2"), (10_000, 20_000), (100, 500)
BOOKS = {"guten600": 600, "guten1k2": 1200}


def experiment_matrix(spark: SparkSession) -> DataFrame:
    """(type, train_data, vocab_size, min_pair_freq): the runs of the grid; BPE has no threshold, so it is null."""
    rows = [("bpe", d, v, None) for d, v in product(CORPORA, SIZES)] + [("wpc", d, v, m) for d, v, m in product(CORPORA, SIZES, THRESHOLDS)]
    return spark.createDataFrame(rows, "type string, train_data string, vocab_size int, min_pair_freq int")


def learner_for(kind: str, vocab_size: int, min_pair_freq: int | None = None) -> Learner:
    """The fast learner of a tokenizer kind."""
    return fast_bpe(vocab_size) if kind.startswith("bpe") else fast_wordpiece(vocab_size, min_pair_freq=min_pair_freq or 1)


def tokenizer_of(model: Model, kind: str) -> Tokenizer:
    return Tokenizer(kind, model.vocab, [m[1:] for m in model.merges], model.learner.end_marker)


def evaluate(tokenizer: Tokenizer, gold: DataFrame, ranked: DataFrame, rare: DataFrame, domains: DataFrame, config: dict) -> DataFrame:
    """One row: the configuration with against_gold, on_freq_words, on_rare_words and avg_fert_per_wt as structs.

    ``domains`` holds rows (domain, text) of wiki and guten; its part is null if the training data is of neither.
    """
    words = gold.select("word").unionByName(ranked.select("word")).unionByName(rare.select("word")).distinct()
    pieces = written(tokenizer.surfaces(words))
    parts = {
        "type": F.lit(config["type"]),
        "train_data": F.lit(config["train_data"]),
        "vocab_size": F.lit(config["vocab_size"]),
        "min_pair_freq": F.lit(config.get("min_pair_freq")).cast("int"),
        "against_gold": M.gold_scores(gold, pieces),
        "on_freq_words": M.freq_words_metrics(ranked, pieces),
        "rare": M.mean_pieces(rare, pieces),
    }
    if config["train_data"].startswith(("wiki", "guten")):
        parts["avg_fert_per_wt"] = M.in_out_domain(M.domain_fertility(domains, tokenizer), config["train_data"])
    else:
        parts["avg_fert_per_wt"] = F.lit(None).cast("struct<in_domain:double,out_domain:double>")
    row = one_row(gold.sparkSession, parts)
    return row.select("type", "train_data", "vocab_size", "min_pair_freq", "against_gold", "on_freq_words", F.col("rare.avg_fertility").alias("on_rare_words"), "avg_fert_per_wt")


def training_corpus(name: str, lines: DataFrame, books: DataFrame) -> DataFrame:
    """(doc_id, text) of a training set of the grid: wiki is the lines (row_id, text), guten600 and guten1k2 the first 600
    and 1,200 of the books (book_id, text)."""
    if name == "wiki":
        return C.corpus_lines(lines.select("row_id", "text").distinct(), "row_id").withColumnRenamed("row_id", "doc_id")
    if name not in BOOKS:
        raise ValueError(f"no training set {name!r}")
    return C.book_lines(books.select("book_id", "text").distinct(), "book_id", BOOKS[name]).select(F.col("book_id").alias("doc_id"), "text")


def run_matrix(spark: SparkSession, corpus, use, models: str | None = None, runs: DataFrame | None = None) -> None:
    """Trains the tokenizer of each run of the grid and hands it to ``use`` (tokenizer, documents, configuration).

    ``corpus`` gives the documents (doc_id, text) of a training set's name; models are saved below ``models``. A training
    set's words are counted once for all its runs.
    """
    rows = sorted((r.asDict() for r in (runs if runs is not None else experiment_matrix(spark)).collect()), key=lambda r: r["train_data"])
    for data, group in groupby(rows, key=lambda r: r["train_data"]):
        docs = corpus(data)
        types = written(word_types(docs))
        for config in group:
            model = learn(types, learner_for(config["type"], config["vocab_size"], config["min_pair_freq"]))
            if models:
                store.save(model, spark, store.place(models, config["type"], data, config["vocab_size"], config["min_pair_freq"]))
            use(tokenizer_of(model, config["type"]), docs, config)


def compare(a: Tokenizer, b: Tokenizer, words: DataFrame) -> DataFrame:
    """The agreement of two tokenizers over words (word)."""
    return M.agreement(a.surfaces(words), b.surfaces(words))


def compare_run(a: Tokenizer, b: Tokenizer, words: DataFrame, configs: tuple[dict, dict]) -> DataFrame:
    """One row of structs: a and b, the configurations of both, and result, their agreement."""
    fields = {"type": "string", "train_data": "string", "vocab_size": "int", "min_pair_freq": "int"}
    sides = [F.struct(*[F.lit(c.get(k)).cast(kind).alias(k) for k, kind in fields.items()]) for c in configs]
    return one_row(words.sparkSession, {"a": sides[0], "b": sides[1], "result": compare(a, b, words)})


def learner_comparison(types: DataFrame, vocab_size: int, min_pair_freq: int = 1, limit: int = 0) -> tuple[DataFrame, dict[str, float]]:
    """(one row: n_merges, same_vocabulary, same_merge_sequence; seconds of each): both WordPiece learners, over the
    ``limit`` most frequent types. They may differ in ties and after a duplicate."""
    some, seconds, got = written(top_words(types, limit)), {}, []
    for name, learner in (("baseline", wordpiece(vocab_size, min_pair_freq=min_pair_freq)), ("fast", fast_wordpiece(vocab_size, min_pair_freq=min_pair_freq))):
        began = time.perf_counter()
        got.append(learn(some, learner))
        seconds[name] = time.perf_counter() - began
    slow, fast = got
    row = (len(slow.merges), set(slow.vocab) == set(fast.vocab), slow.merges == fast.merges)
    return types.sparkSession.createDataFrame([row], "n_merges int, same_vocabulary boolean, same_merge_sequence boolean"), seconds


def engine_comparison(types: DataFrame, learner: Learner) -> bool:
    """Whether both engines of a learner give the same merges and vocabulary."""
    a, b = learn(types, learner), learn_distributed(types, learner)
    return a.merges == b.merges and a.vocab == b.vocab


def ambiguity_report(types: DataFrame, vocab_size: int = 1000, words: int = 2000, shown: int = 20) -> tuple[DataFrame, DataFrame]:
    """(rate, examples): BPE trained on the most frequent words; how often merge replay and longest match differ."""
    some = written(top_words(types, words))
    model = learn(some, fast_bpe(vocab_size))
    a, b = (tokenizer_of(model, k).segment(some) for k in ("bpe", "bpe_long"))
    return M.ambiguity_rate(some, a, b), M.ambiguous(some, a, b).orderBy(F.desc("freq"), "word").limit(shown)


def segmentation_race(words: DataFrame, vocab: list[str]) -> DataFrame:
    """One row: n_words, n_different, same_outputs, and the seconds of the joins and of the tries with their quotient
    (null if the tries took none). Both run to the end over the same different words."""
    own, seconds, done = written(words.select("word").distinct()), [], []
    for make in (lambda: Tokenizer("wpc", vocab).segment(own, joins=True), lambda: trie_match(own, vocab, "wordpiece")):
        began = time.perf_counter()
        done.append(written(make()))
        seconds.append(time.perf_counter() - began)
    slow, fast = seconds
    return M.same_outputs(*done).withColumns({"baseline_seconds": F.lit(slow), "fast_seconds": F.lit(fast), "speedup": F.lit(slow / fast if fast else None).cast("double")})


def wordpiece_experiment(train: DataFrame, test: DataFrame, vocab_size: int = 5000, min_pair_freq: int = 1, eval_tokens: int = 100_000, race_types: int = 0) -> DataFrame:
    """One row of structs: settings, corpus_statistics, vocabulary_training, tokenization_comparison and, if
    ``race_types`` is over 0, experimental_fast_training. Tables: doc_id, text."""
    spark, types = train.sparkSession, written(word_types(train))
    began = time.perf_counter()
    model = learn(types, fast_wordpiece(vocab_size, min_pair_freq=min_pair_freq))
    seconds = time.perf_counter() - began
    tokens = first_tokens(test, eval_tokens).groupBy("word").agg(F.count("*").alias("freq"))
    tokens = written(tokens)
    vocab = model.vocab
    joined = Tokenizer("wpc", vocab).segment(tokens)
    both = one_row(spark, {"m": M.text_metrics(tokens, joined), "s": segmentation_race(tokens, vocab)}).select("m.*", "s.*")
    parts = {
        "settings": F.struct(F.lit(vocab_size).alias("vocab_size"), F.lit(min_pair_freq).alias("min_pair_freq"), F.lit(eval_tokens).alias("eval_tokens")),
        "corpus_statistics": corpus_stats(train),
        "vocabulary_training": F.struct(F.lit(len(vocab)).alias("vocabulary"), F.lit(len(model.merges)).alias("merges"), F.lit(seconds).alias("seconds")),
        "tokenization_comparison": both,
    }
    if race_types > 0:
        parts["experimental_fast_training"] = learner_comparison(types, vocab_size, min_pair_freq, race_types)[0]
    return one_row(spark, parts)


def ranked_types(docs: DataFrame, n: int) -> DataFrame:
    """(rank, word): the ``n`` most frequent words, ties by the word; ranks from 0. The window is over these n rows."""
    top = word_freq(docs).orderBy(F.desc("freq"), "word").limit(n)
    return top.select((F.row_number().over(W.orderBy(F.desc("freq"), "word")) - 1).alias("rank"), "word")

