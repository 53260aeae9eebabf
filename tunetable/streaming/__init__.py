"""Streaming: row-local operators on streams and the windowed latency metric."""
