"""Operators for large-scale training-text preparation, one module per operator."""
