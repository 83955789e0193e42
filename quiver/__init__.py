"""Quiver: typed property graphs on Spark DataFrames."""
