"""Structured Streaming jobs: job monitor, resumable ingest, replay-safe rows."""
