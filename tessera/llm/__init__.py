"""Operators for preparing training data; self-contained, nothing else in the library imports them."""
