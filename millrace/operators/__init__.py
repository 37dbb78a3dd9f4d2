"""Table-to-table operators: each takes and returns lazy DataFrames."""
