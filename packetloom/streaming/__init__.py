"""Incremental forms of ingestion and counting."""
