"""Operators for training data made of text; nothing outside this package imports it."""
