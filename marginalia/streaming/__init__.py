"""Structured Streaming over a ledger that is still being written."""
