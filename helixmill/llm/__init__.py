"""Operators for large training-corpus pipelines; nothing outside this package imports it."""
