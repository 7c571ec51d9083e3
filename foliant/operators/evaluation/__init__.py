"""Measures of each stage, as aggregations."""
