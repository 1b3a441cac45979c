"""Whole plans: the weekly pipeline, and the catalogue of queries."""
