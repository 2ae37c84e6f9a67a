"""Structured Streaming jobs (claim totals maintained as files arrive)."""
