"""A query engine for an arrow-chained, model-aware query language, on Spark DataFrames."""
