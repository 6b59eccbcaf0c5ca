"""Structured Streaming forms of the ingest and rate operators."""
