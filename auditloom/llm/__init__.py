"""Operators for training-data pipelines: tokens, quality, language, toxicity, duplicates, leaks, archives."""
