"""Count tables of taxa by sample, analysed as Spark DataFrames."""
