"""The queries of the operators in this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiloom.functions.text import words
from lexiloom.llm import encode, heavy, leaks, mixing, overlaps, repeats, sentences, terms
from lexiloom.sources.tables import table


def _evals(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"valid": table(s, d, "wiki_valid"), "test": table(s, d, "wiki_test")}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: repeats.found(table(s, d, "gutenberg")),
        "p1_sequences": lambda s, d: repeats.sequences(table(s, d, "gutenberg")),
        "p1_cleaned": lambda s, d: repeats.cleaned(table(s, d, "gutenberg")),
        "p2_found": lambda s, d: terms.found(table(s, d, "word_freqs")),
        "p2_terms": lambda s, d: terms.marked_terms(table(s, d, "word_freqs")),
        "p2_ngrams": lambda s, d: terms.ngram_counts(table(s, d, "documents"), words("text")),
        "p3_found": lambda s, d: heavy.found(table(s, d, "word_freqs")),
        "p3_heavy": lambda s, d: heavy.heavy_hitters(terms.clean_rows(table(s, d, "word_freqs"))).select("term", "total"),
        "p4_found": lambda s, d: overlaps.overlaps(table(s, d, "wiki_train"), _evals(s, d)),
        "p4_report": lambda s, d: overlaps.report(table(s, d, "wiki_train"), _evals(s, d)),
        "p5_found": lambda s, d: leaks.found(table(s, d, "gutenberg"), table(s, d, "guten_test")),
        "p5_report": lambda s, d: leaks.report(table(s, d, "gutenberg"), table(s, d, "guten_test")),
        "p6_ids": lambda s, d: encode.encoded(table(s, d, "documents")),
        "p6_decoded": lambda s, d: encode.decoded(table(s, d, "documents")),
        "p7_selection": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets")).selection(),
        "p7_shares": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets")).shares(),
        "p7_quotas": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets")).wanted(),
        "p8_found": lambda s, d: sentences.sentences(table(s, d, "documents")),
    }
