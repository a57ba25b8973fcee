"""Trained models in folders named by their configuration."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lexiloom.functions import tokens as T
from lexiloom.operators.learn import Model
from lexiloom.operators.segment import Tokenizer


def place(root: str, kind: str, train_data: str, vocab_size: int, min_pair_freq: int | None = None) -> str:
    """The folder of a model; both WordPiece tokenizers share one, and BPE has no threshold."""
    family = "bpe" if kind.startswith("bpe") else "wpc"
    least = f"_{min_pair_freq or 1}" if family == "wpc" else ""
    return f"{root}/{family}_{train_data}_{vocab_size}{least}"


def save(model: Model, spark: SparkSession, path: str) -> None:
    """vocab (id, token) and merges (rank, a, b, merged) as parquet."""
    model.vocab_df(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
    model.merges_df(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")


def load(spark: SparkSession, path: str, kind: str) -> Tokenizer:
    """The tokenizer of a saved model; the end marker is read off the vocabulary."""
    vocab = [r.token for r in spark.read.parquet(f"{path}/vocab").orderBy("id").collect()]
    merges = [(r.a, r.b, r.merged) for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]
    return Tokenizer(kind, vocab, merges, T.END if T.END in vocab[:2] else None)
