"""Operators for preparing text corpora."""
