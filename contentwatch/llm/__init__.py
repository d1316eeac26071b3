"""Corpus operators: deduplication, filtering, scoring and tokenising of training text."""
