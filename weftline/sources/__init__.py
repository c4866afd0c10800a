"""Readers and writers of graphs, logs and files."""
