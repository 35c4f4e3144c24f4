"""Composite dataflows built from operators: search, write-back, ingest, evaluation."""
