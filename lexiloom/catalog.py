"""The core's queries: each takes (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import tokens as T
from lexiloom.operators import metrics as M
from lexiloom.operators import pairs as P
from lexiloom.operators import words as Wd
from lexiloom.operators.learn import Learner, Model, fast_bpe, fast_wordpiece, learn, naive_bpe, wordpiece
from lexiloom.operators.segment import Tokenizer, longest_match, trie_match
from lexiloom.plans import experiments as X
from lexiloom.plans.lineage import cut, scratch
from lexiloom.sources import corpus as C
from lexiloom.sources.tables import table

#: Merges that the queries of the learners make.
STEPS = 20
# The merges and vocabularies of the queries of the segmenters.
MERGES = [("t", "h"), ("e", "_"), ("n", "_"), ("e", "r"), ("t", "_"), ("i", "n"), ("s", "_"), ("o", "u"), ("a", "t"), ("th", "e_"), ("er", "_"), ("in", "g"), ("ing", "_"), ("e", "n"), ("r", "e"), ("a", "n"), ("an", "d"), ("o", "n_"), ("s", "t"), ("l", "e"), ("at", "i"), ("ati", "on_"), ("f", "u"), ("fu", "l"), ("ou", "l")]
NAIVE_MERGES = [("t", "h"), ("e", "r"), ("i", "n"), ("o", "u"), ("a", "t"), ("th", "e"), ("in", "g"), ("e", "n"), ("r", "e"), ("a", "n"), ("an", "d"), ("o", "n"), ("s", "t"), ("l", "e"), ("at", "i"), ("ati", "on"), ("f", "u"), ("fu", "l"), ("ou", "l")]
LETTERS = list("abcdefghijklmnoprstuvwxyz'")  # no q: it is unknown
PIECES = ["th", "he", "the", "in", "ing", "er", "ou", "at", "ation", "en", "re", "an", "and", "on", "st", "le", "ful", "ment", "ness", "able", "sh", "ck"]


def bpe_vocab_list() -> list[str]:
    return [T.UNK, T.END, *LETTERS, *(a + b for a, b in MERGES)]


def naive_vocab_list() -> list[str]:
    return [T.UNK, *LETTERS, *(a + b for a, b in NAIVE_MERGES)]


def wp_vocab_list() -> list[str]:
    whole = [*LETTERS, *PIECES]
    return [T.WP_UNK, *whole, *(T.CONT + p for p in whole)]


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _types(s: SparkSession, d: str) -> DataFrame:
    return Wd.word_types(_docs(s, d))


def _words(s: SparkSession, d: str) -> DataFrame:
    return Wd.word_freq(_docs(s, d))


def literal(s: SparkSession, d: str, *kinds: str) -> list[Tokenizer]:
    """The tokenizers of ``kinds`` (bpe, bpe_long, naive, naive_long, wp) with the vocabularies above."""
    bpe, naive = ([(a, b, a + b) for a, b in merges] for merges in (MERGES, NAIVE_MERGES))
    own = {
        "bpe": lambda: Tokenizer("bpe", bpe_vocab_list(), bpe),
        "bpe_long": lambda: Tokenizer("bpe_long", bpe_vocab_list()),
        "naive": lambda: Tokenizer("bpe", naive_vocab_list(), naive, None),
        "naive_long": lambda: Tokenizer("bpe_long", naive_vocab_list(), end_marker=None),
        "wp": lambda: Tokenizer("wpc", wp_vocab_list()),
    }
    return [own[k]() for k in kinds]


def _model(s: SparkSession, d: str, learner: Learner, **more) -> Model:
    return learn(_types(s, d), learner, **more)


def _joined(segmented: DataFrame) -> DataFrame:
    return segmented.select("word", F.array_join("pieces", " ").alias("pieces"))


def wiki_lines(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): the training lines of wiki."""
    return X.training_corpus("wiki", table(s, d, "wiki_train"), table(s, d, "gutenberg"))


def _rarest(s: SparkSession, d: str) -> DataFrame:
    return Wd.rarest_words(Wd.rare_types(_docs(s, d)))


def _texts(tokenizer: Tokenizer, docs: DataFrame) -> DataFrame:
    """(doc_id, n_pieces, n_different) of the texts with a word; each is counted where it lies."""
    flat = tokenizer.texts(docs).select("doc_id", F.flatten("pieces").alias("p")).where(F.size("p") > 0)
    return flat.select("doc_id", F.size("p").cast("bigint").alias("n_pieces"), F.size(F.array_distinct("p")).cast("bigint").alias("n_different"))


def _ranked(s: SparkSession, d: str) -> DataFrame:
    return cut(X.ranked_types(_docs(s, d), 10_000))


def gold(s: SparkSession, d: str) -> DataFrame:
    return C.gold(table(s, d, "gold_segmentation"))


def domains(s: SparkSession, d: str) -> DataFrame:
    wiki = table(s, d, "wiki_test").select(F.lit("wiki").alias("domain"), "text")
    return wiki.unionByName(table(s, d, "guten_test").select(F.lit("guten").alias("domain"), F.col("line").alias("text")))


def _types_like(s: SparkSession, d: str, learner: Learner) -> DataFrame:
    return _words(s, d).select("freq", learner.split(F.col("word")).alias("sp"))


def _vocab_df(s: SparkSession, tokens: list[str]) -> DataFrame:
    return s.createDataFrame([(t,) for t in tokens], "token string")


BPE, NAIVE = fast_bpe(10**6, max_merges=STEPS), naive_bpe(10**6, max_merges=STEPS)
WP, WP_SLOW = fast_wordpiece(10**6, max_merges=STEPS, min_pair_freq=20), wordpiece(10**6, max_merges=STEPS, min_pair_freq=20)


def segmenter_queries(t: Callable[..., list[Tokenizer]]) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries that segment; ``t`` (spark, folder, kinds) gives their tokenizers."""
    return {
        # segmenters
        "bpe_tokenize": lambda s, d: _joined(t(s, d, "bpe")[0].segment(_words(s, d))),
        "bpe_longest": lambda s, d: _joined(t(s, d, "bpe_long")[0].segment(_words(s, d))),
        "naive_bpe_tokenize": lambda s, d: _joined(t(s, d, "naive")[0].segment(_words(s, d))),
        "naive_bpe_longest": lambda s, d: _joined(t(s, d, "naive_long")[0].segment(_words(s, d))),
        "wp_encode": lambda s, d: _joined(t(s, d, "wp")[0].segment(_words(s, d))),
        "wp_encode_joined": lambda s, d: _joined(t(s, d, "wp")[0].segment(_words(s, d), joins=True)),
        "bpe_longest_joined": lambda s, d: _joined(t(s, d, "bpe_long")[0].segment(_words(s, d), joins=True)),
        "wp_encode_trie": lambda s, d: _joined(trie_match(_words(s, d), t(s, d, "wp")[0].vocab, "wordpiece")),
        "bpe_longest_trie": lambda s, d: _joined(trie_match(_words(s, d), t(s, d, "bpe_long")[0].vocab)),
        "wp_tokenize_docs": lambda s, d: _texts(t(s, d, "wp")[0], _docs(s, d)),
        "wp_trie_equals_baseline": lambda s, d: (lambda v: M.same_outputs(longest_match(_words(s, d), _vocab_df(s, v), "wordpiece"), trie_match(_words(s, d), v, "wordpiece")))(t(s, d, "wp")[0].vocab),
        # metrics
        "wp_type_metrics": lambda s, d: M.type_metrics(t(s, d, "wp")[0].segment(_words(s, d))),
        "wp_text_metrics": lambda s, d: (lambda w: M.text_metrics(w, t(s, d, "wp")[0].segment(w)))(_words(s, d)),
        "wp_output_metrics": lambda s, d: (lambda w: M.text_metrics(w, trie_match(w, t(s, d, "wp")[0].vocab, "wordpiece")).select("n_tokens", "n_pieces", "avg_pieces", "unk_rate", "single_known_rate"))(_words(s, d)),
        "ambiguity_rate": lambda s, d: M.ambiguity_rate(_words(s, d), *(x.segment(_words(s, d)) for x in t(s, d, "bpe", "bpe_long"))),
        "ambiguous_top20": lambda s, d: M.ambiguous(_words(s, d), *(x.segment(_words(s, d)) for x in t(s, d, "bpe", "bpe_long"))).orderBy(F.desc("freq"), "word").limit(20).select("word", "freq", F.array_join("standard", " ").alias("standard"), F.array_join("longest", " ").alias("longest")),
        "freq_words_metrics": lambda s, d: (lambda w: M.freq_words_metrics(w, t(s, d, "bpe")[0].surfaces(w)))(_ranked(s, d)),
        "least_words_fertility": lambda s, d: (lambda w: M.mean_pieces(w, t(s, d, "bpe")[0].surfaces(w)))(cut(_rarest(s, d).select("word"))),
        "domain_fertility": lambda s, d: M.domain_fertility(domains(s, d), t(s, d, "bpe")[0]),
        "wp_domain_fertility": lambda s, d: M.domain_fertility(domains(s, d), t(s, d, "wp")[0]),
        "in_out_domain": lambda s, d: M.in_out_domain(M.domain_fertility(domains(s, d), t(s, d, "bpe")[0]), "wiki"),
        # gold and agreement
        "gold_prf": lambda s, d: (lambda g: M.gold_scores(g, t(s, d, "bpe")[0].surfaces(g)))(gold(s, d)),
        "gold_prf_wp": lambda s, d: (lambda g: M.gold_scores(g, t(s, d, "wp")[0].surfaces(g)))(gold(s, d)),
        "pairwise_agreement": lambda s, d: X.compare(*t(s, d, "bpe", "wp"), _ranked(s, d)),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # words
        "word_freq": _words,
        "top_words": lambda s, d: Wd.top_words(_types(s, d), 50).select("word", "freq"),
        "corpus_lines": lambda s, d: C.corpus_lines(table(s, d, "wiki_train").select("row_id", "text").distinct(), "row_id"),
        "corpus_lines_limited": lambda s, d: C.corpus_lines(table(s, d, "wiki_train").select("row_id", "text").distinct(), "row_id", 500),
        "book_lines": lambda s, d: C.book_lines(table(s, d, "gutenberg").select("book_id", "text").distinct(), "book_id"),
        "alphabet": lambda s, d: Wd.alphabet(_words(s, d), BPE.split),
        "wp_alphabet": lambda s, d: Wd.alphabet(_words(s, d), WP.split),
        "word_tokens_first_n": lambda s, d: Wd.first_tokens(_docs(s, d), 1000),
        "rare_words": lambda s, d: _rarest(s, d).select("word", "freq"),
        "corpus_stats": lambda s, d: Wd.corpus_stats(_docs(s, d)),
        "fertility_tokens": lambda s, d: Wd.fertility_tokens(_docs(s, d)),
        # splits and pairs
        "bpe_init_split": lambda s, d: _words(s, d).select("word", BPE.split(F.col("word")).alias("sp")),
        "naive_bpe_init_split": lambda s, d: _words(s, d).select("word", NAIVE.split(F.col("word")).alias("sp")),
        "wp_init_split": lambda s, d: _words(s, d).select("word", WP.split(F.col("word")).alias("sp")),
        "pair_freq": lambda s, d: P.pair_freq(_types_like(s, d, BPE)),
        "symbol_freq": lambda s, d: P.symbol_freq(_types_like(s, d, WP)),
        "wp_pair_scores": lambda s, d: P.pair_scores(_types_like(s, d, WP)),
        "wp_pair_scores_min100": lambda s, d: P.pair_scores(_types_like(s, d, WP), 100),
        "pair_score": lambda s, d: P.pair_score(_types_like(s, d, WP), "t", "##h"),
        # learners
        "bpe_merges_distributed": lambda s, d: _model(s, d, BPE, max_local=0).merges_df(s),
        "wp_merges_distributed": lambda s, d: _model(s, d, WP, max_local=0).merges_df(s),
        "bpe_merges_lex": lambda s, d: _model(s, d, BPE).merges_df(s),
        "bpe_merges_naive": lambda s, d: _model(s, d, NAIVE).merges_df(s),
        "wp_merges_lex": lambda s, d: _model(s, d, WP).merges_df(s),
        "wp_merges_first_seen": lambda s, d: _model(s, d, WP_SLOW).merges_df(s),
        "bpe_vocab": lambda s, d: _model(s, d, BPE).vocab_df(s),
        "wp_vocab": lambda s, d: _model(s, d, WP).vocab_df(s).select("token"),
        "bpe_train_splits": lambda s, d: _model(s, d, BPE).splits.select("word", "freq", "sp"),
        "wp_train_splits": lambda s, d: _model(s, d, WP).splits.select("word", "freq", "sp"),
        "learner_comparison": lambda s, d: X.learner_comparison(_types(s, d), 500, limit=2000)[0],
        **segmenter_queries(literal),
        # gold
        "gold_parse": lambda s, d: gold(s, d).select("word", F.array_join("surfaces", " ").alias("surfaces")),
        "boundary_vectors": lambda s, d: M.boundary_vectors(gold(s, d).withColumnRenamed("surfaces", "pieces")).select("word", F.array_join(F.col("vec").cast("array<string>"), "").alias("vec")),
        # runs
        "experiment_matrix": lambda s, d: X.experiment_matrix(s),
        "eval_run": lambda s, d: flat(_record(s, d)),
        "agreement_log": lambda s, d: flat_agreement(_agreement(s, d)),
        "ambiguity_report": lambda s, d: X.ambiguity_report(_types(s, d))[0],
        "ambiguity_examples": lambda s, d: X.ambiguity_report(_types(s, d))[1].select("word", "freq", F.array_join("standard", " ").alias("standard"), F.array_join("longest", " ").alias("longest")),
        "segmentation_race": lambda s, d: X.segmentation_race(_words(s, d), wp_vocab_list()).select("n_words", "n_different", "same_outputs"),
        # what is written and read again
        "lines_written": _lines_written,
        "splits_written": _splits_written,
        "books_written": _books_written,
        "lines_read": _lines_read,
        "ranked_words_read": _ranked_words_read,
        "word_counts_read": _word_counts_read,
        "word_counts_written": _word_counts_written,
        "vocabulary_written": _vocabulary_written,
        "merges_written": _merges_written,
        "gold_read": _gold_read,
        "examples_written": _examples_written,
        "record_written": _record_written,
        "eval_log": _eval_log,
    }


def _record(s: SparkSession, d: str) -> DataFrame:
    rare = cut(_rarest(s, d).select("word"))
    return X.evaluate(literal(s, d, "bpe")[0], gold(s, d), _ranked(s, d), rare, domains(s, d), {"type": "bpe", "train_data": "wiki", "vocab_size": len(bpe_vocab_list())})


def _agreement(s: SparkSession, d: str) -> DataFrame:
    """The agreement of two tokenizers with their configurations, from its log."""
    configs = {"type": "bpe", "train_data": "wiki", "vocab_size": len(bpe_vocab_list())}, {"type": "wpc", "train_data": "wiki", "vocab_size": len(wp_vocab_list()), "min_pair_freq": 100}
    path = scratch(s)
    C.append_log(X.compare_run(*literal(s, d, "bpe", "wp"), _ranked(s, d), configs), path)
    return s.read.schema("a struct<type:string,train_data:string,vocab_size:int,min_pair_freq:int>, b struct<type:string,train_data:string,vocab_size:int,min_pair_freq:int>, result struct<kappa:double,f1:double,per_word_kappa:double,per_word_f1:double>").json(path)


def flat_agreement(row: DataFrame) -> DataFrame:
    sides = [F.col(f"{x}.{f}").alias(f"{x}_{f}") for x in ("a", "b") for f in ("type", "train_data", "vocab_size", "min_pair_freq")]
    return row.select(*sides, "result.*")


def _counted(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def _lines_written(s: SparkSession, d: str) -> DataFrame:
    C.write_lines(table(s, d, "wiki_valid"), "text", path := scratch(s))
    return _counted(s.read.text(path).withColumnRenamed("value", "text"), "text")


def _splits_written(s: SparkSession, d: str) -> DataFrame:
    C.write_splits({x: table(s, d, f"wiki_{x}") for x in ("train", "valid", "test")}, path := scratch(s))
    return _counted(s.read.text(path).withColumnRenamed("value", "text"), "split", "text")


def _books_written(s: SparkSession, d: str) -> DataFrame:
    """By the command line's ``prepare``."""
    from lexiloom.__main__ import main

    main(["prepare", "--books", f"{d}/gutenberg.parquet", "--out", path := scratch(s)], s)
    parts = [s.read.text(f"{path}/{p}").select(F.lit(p).alias("part"), F.col("value").alias("text")) for p in ("all", "subset")]
    return _counted(parts[0].unionAll(parts[1]), "part", "text")


def _lines_read(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "guten_test").select(F.explode(F.split("line", r"[\r\n]+")).alias("value"))
    lines.select(F.concat("value", F.lit(" \t"))).write.text(path := scratch(s))
    return _counted(C.text_lines(s, path), "text")


def _ranked_words_read(s: SparkSession, d: str) -> DataFrame:
    C.write_words(_ranked(s, d), path := scratch(s))
    return C.ranked_words(s, path)


def _word_counts_read(s: SparkSession, d: str) -> DataFrame:
    C.write_word_counts_json(Wd.top_words(_types(s, d), 2000), path := scratch(s))
    return C.word_counts_json(s, path).select("word", "freq")


def _word_counts_written(s: SparkSession, d: str) -> DataFrame:
    C.write_word_counts(Wd.rare_types(_docs(s, d)), path := scratch(s))
    return s.read.text(path).select(F.split("value", " ")[0].cast("bigint").alias("freq"), F.split("value", " ")[1].alias("word"))


def _vocabulary_written(s: SparkSession, d: str) -> DataFrame:
    C.write_vocabulary(Wd.alphabet(_words(s, d), WP.split).withColumnRenamed("symbol", "token"), path := scratch(s))
    return C.vocabulary(s, path)


def _merges_written(s: SparkSession, d: str) -> DataFrame:
    C.write_merges(_model(s, d, BPE).merges_df(s), path := scratch(s))
    return C.merges(s, path)


def _gold_read(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "gold_segmentation").orderBy("line_no").coalesce(1)
    rows.select(F.concat_ws("\t", F.coalesce("word", F.lit("")), "analyses").alias("value")).write.text(path := scratch(s))
    return C.gold(C.gold_tsv(s, path)).select("word", F.array_join("surfaces", " ").alias("surfaces"))


def _examples_written(s: SparkSession, d: str) -> DataFrame:
    C.write_examples(literal(s, d, "wp")[0].segment(gold(s, d)), path := scratch(s))
    return s.read.csv(path, header=True)


def _record_written(s: SparkSession, d: str) -> DataFrame:
    C.write_json(Wd.corpus_stats(_docs(s, d)), path := scratch(s))
    return s.read.json(path)


def _eval_log(s: SparkSession, d: str) -> DataFrame:
    """The log of a run that is made twice."""
    record, path = cut(_record(s, d)), scratch(s)
    for _ in range(2):
        C.append_log(record, path)
    return flat(s.read.schema(record.schema).json(path))


def flat(row: DataFrame) -> DataFrame:
    return row.select("type", "train_data", "vocab_size", "min_pair_freq", "against_gold.*", "on_freq_words.*", "on_rare_words", "avg_fert_per_wt.*")
