"""Readers and writers of tree, sequence, report and metric files."""
