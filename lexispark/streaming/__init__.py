"""Append ingestion with Structured Streaming."""
