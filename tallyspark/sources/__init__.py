"""Readers of ledgers: text files, Parquet tables in a posting schema, builders and generators."""
