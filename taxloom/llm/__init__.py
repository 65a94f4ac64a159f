"""Operators for preparing training corpora, built on Spark DataFrames."""
