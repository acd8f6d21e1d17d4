"""Operators for preparing text corpora and vectors; the rest of the library does not use them."""
