"""Operators of training-text pipelines. Nothing outside this package imports it."""
