"""Streaming jobs: one transformation each, for a batch or a stream of clicks."""
