"""Schema alignment, mapping ledgers and knowledge-graph materialisation on Spark DataFrames."""
