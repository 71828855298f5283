"""Structured Streaming forms of ingest, activity counts and tag uniqueness."""
