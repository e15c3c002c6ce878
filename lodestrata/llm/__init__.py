"""Operators for building training corpora at scale; nothing else in the library imports them."""
