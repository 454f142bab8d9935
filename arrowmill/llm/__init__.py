"""Training-data operators on DataFrames of documents; nothing else in the library imports this package."""
