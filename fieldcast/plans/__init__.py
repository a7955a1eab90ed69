"""Whole queries: the report layer and its inputs derived from the benchmark tables."""
