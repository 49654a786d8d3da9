"""Incremental ingest of the weekly feed."""
