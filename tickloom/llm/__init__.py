"""Corpus operators for training-data pipelines; `queries` registers them."""
