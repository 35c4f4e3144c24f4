"""Batch memory retrieval and curation on Spark DataFrames."""
