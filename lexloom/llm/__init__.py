"""Operators for preparing text corpora for model training; nothing outside this folder imports it."""
