"""Incremental ingestion of new repertoire files."""
