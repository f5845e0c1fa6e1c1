"""Operators for large corpora of training text; nothing else in the library imports them."""
