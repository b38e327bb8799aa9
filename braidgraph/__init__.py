"""Repository-graph analytics on DataFrames."""
