"""Structured Streaming extensions: incremental upserts and stream-static search."""
