"""Spatial-pattern, graph, segment and grouped-statistics analytics on Spark DataFrames."""
