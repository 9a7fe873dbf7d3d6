"""Queries over the driver tables, and the views that give those the shape of a tree corpus."""
