"""Operators for preparing text corpora; nothing outside this package imports it."""
