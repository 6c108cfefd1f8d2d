"""Operators for building and cleaning training corpora; nothing else in the library imports them."""
