"""Structured Streaming forms of ingest, windows, matching and clustering."""
