"""Operators for large text and vector collections used in training. Nothing outside imports this package."""
