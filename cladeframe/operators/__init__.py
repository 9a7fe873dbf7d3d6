"""Operators on DataFrames: summaries, inventories, trees, features, networks, labels, models."""
