"""Whole pipelines and the catalogue of registered queries."""
