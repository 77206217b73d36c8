"""Structured Streaming twins of the call-log operators."""
