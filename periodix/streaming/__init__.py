"""Structured Streaming: incremental ingest of arriving workbooks."""
