"""Structured Streaming: event streams folded to the tables that the batch operators score."""
