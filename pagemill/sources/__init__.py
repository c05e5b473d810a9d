"""Sources: files, text-line records, sidecars and messages as DataFrames."""
