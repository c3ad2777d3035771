"""Sources (landed files -> DataFrames) and sinks (DataFrames -> files)."""
