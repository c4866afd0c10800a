"""Column functions: text and size metrics, scores, scalar helpers."""
