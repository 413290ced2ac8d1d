"""Readers, writers and the entity fixtures derived from the test tables."""

from tarnwork.sources.io import read_parquet, read_table, read_tsv, write_json, write_parquet, write_tsv

__all__ = ["read_parquet", "read_table", "read_tsv", "write_json", "write_parquet", "write_tsv"]
