"""Subword-tokenization analytics on Spark DataFrames."""
