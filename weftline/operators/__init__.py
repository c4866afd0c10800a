"""Operators on graph, tag, metric and log frames."""
