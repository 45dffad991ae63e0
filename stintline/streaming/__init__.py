"""Structured Streaming: the same operators over rounds as they arrive."""
