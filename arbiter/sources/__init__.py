"""Sources and sinks: parquet tables, JSON question sets and caches, fixtures."""
