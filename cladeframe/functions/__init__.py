"""Column functions for labels, names and tree text."""
