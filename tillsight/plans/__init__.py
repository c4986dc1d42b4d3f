"""Plan-level patterns: shared-folder tables, group statistics on rows, exact percentiles."""
