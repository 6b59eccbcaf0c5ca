"""Operators for training text: leakage of evaluation items, source mixing, sentence boundaries."""
