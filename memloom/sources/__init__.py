"""Readers and writers for items, documents, commit logs, golden sets and event lines."""
