"""Batch analytics over exported photo and video archives, built on Spark DataFrames."""
