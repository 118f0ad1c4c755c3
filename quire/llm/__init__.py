"""Operators for text collections. Nothing outside this package imports it."""
