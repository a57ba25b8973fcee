"""The core's whole jobs, for which there is no SQL: those that SQL reaches only for a part of the texts or by a small model.

Each query is named as the one of the catalog that has SQL, with ``_whole`` behind it, and takes (spark, folder of the tables).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom import catalog
from lexiloom.operators import words as Wd
from lexiloom.operators.learn import Learner, Model, fast_bpe, fast_wordpiece, learn, naive_bpe, wordpiece
from lexiloom.operators.segment import Tokenizer
from lexiloom.plans import experiments as X
from lexiloom.plans.lineage import cut, written
from lexiloom.sources.tables import table

#: Tokens of a learned vocabulary, the smaller size of the reference's grid.
SIZE = 10_000
BPE, NAIVE, WP, WP_SLOW = fast_bpe(SIZE), naive_bpe(SIZE), fast_wordpiece(SIZE), wordpiece(SIZE)


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _model(s: SparkSession, d: str, learner: Learner) -> Model:
    return learn(Wd.word_types(_docs(s, d)), learner)


def _learned(s: SparkSession, d: str, *kinds: str) -> list[Tokenizer]:
    """As :func:`catalog.literal`, of models learned from wiki; a model that several kinds share is learned once."""
    types, models, out = written(Wd.word_types(catalog.wiki_lines(s, d))), {}, []
    for kind in kinds:
        learner = WP if kind == "wp" else NAIVE if kind.startswith("naive") else BPE
        if learner not in models:
            models[learner] = learn(types, learner)
        out.append(X.tokenizer_of(models[learner], "wpc" if kind == "wp" else "bpe_long" if kind.endswith("_long") else "bpe"))
    return out


def _eval_run(s: SparkSession, d: str) -> DataFrame:
    """One record of a BPE trained on wiki, with the frequent and rare words of its training lines."""
    lines, (bpe,) = catalog.wiki_lines(s, d), _learned(s, d, "bpe")
    rare = cut(Wd.rarest_words(Wd.rare_types(lines)).select("word"))
    ranked, config = cut(X.ranked_types(lines, 10_000)), {"type": "bpe", "train_data": "wiki", "vocab_size": len(bpe.vocab)}
    return catalog.flat(X.evaluate(bpe, catalog.gold(s, d), ranked, rare, catalog.domains(s, d), config))


def _experiment(s: SparkSession, d: str) -> DataFrame:
    """A WordPiece run trained on wiki and tried on its test lines, without its times."""
    test = table(s, d, "wiki_test").select(F.col("row_id").alias("doc_id"), "text")
    row = X.wordpiece_experiment(catalog.wiki_lines(s, d), test, SIZE)
    shown = ["n_tokens", "n_pieces", "avg_pieces", "unk_rate", "single_rate", "single_known_rate", "n_words", "n_different", "same_outputs"]
    return row.select("corpus_statistics.*", "vocabulary_training.vocabulary", "vocabulary_training.merges", *[f"tokenization_comparison.{c}" for c in shown])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # learners
        "bpe_merges_lex_whole": lambda s, d: _model(s, d, BPE).merges_df(s),
        "bpe_merges_naive_whole": lambda s, d: _model(s, d, NAIVE).merges_df(s),
        "wp_merges_lex_whole": lambda s, d: _model(s, d, WP).merges_df(s),
        "wp_merges_first_seen_whole": lambda s, d: _model(s, d, WP_SLOW).merges_df(s),
        "bpe_vocab_whole": lambda s, d: _model(s, d, BPE).vocab_df(s),
        "wp_vocab_whole": lambda s, d: _model(s, d, WP).vocab_df(s).select("token"),
        "bpe_train_splits_whole": lambda s, d: _model(s, d, BPE).splits.select("word", "freq", "sp"),
        "wp_train_splits_whole": lambda s, d: _model(s, d, WP).splits.select("word", "freq", "sp"),
        "learner_comparison_whole": lambda s, d: X.learner_comparison(Wd.word_types(_docs(s, d)), SIZE)[0],
        # segmenters and metrics with learned models
        **{f"{name}_whole": query for name, query in catalog.segmenter_queries(_learned).items()},
        "eval_run_whole": _eval_run,
        "wordpiece_experiment": _experiment,
    }
