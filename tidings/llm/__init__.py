"""Operators and the pipeline for training data: text quality, duplicates, tokens, shards."""
