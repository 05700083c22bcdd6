"""Streaming forms of additive summaries and first-occurrence rules."""
