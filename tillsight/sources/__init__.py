"""Readers and writers."""

from tillsight.sources.readers import read_feed, read_notices, read_raw
from tillsight.sources.registry import append_metrics, load_metrics
from tillsight.sources.writers import write_scores, write_table

__all__ = [
    "append_metrics",
    "load_metrics",
    "read_feed",
    "read_notices",
    "read_raw",
    "write_scores",
    "write_table",
]
