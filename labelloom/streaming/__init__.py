"""Structured Streaming: log flushes, windows, crawl state, polled hits."""
