"""Structured Streaming jobs: ingestion into bronze, upserts into silver, replay de-duplication."""
