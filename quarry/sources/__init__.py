"""Readers and writers: Markdown vaults, JSON lines, Parquet collections, CSV, and the driver tables."""
