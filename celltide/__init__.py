"""Single-cell multi-omics tables, matrices, intervals and graphs as Spark DataFrames."""
