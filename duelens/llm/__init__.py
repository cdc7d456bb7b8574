"""Operators for building training corpora: ten methods and the queries that apply them."""
