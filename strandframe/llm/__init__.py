"""Operators for training text: percentiles, packing, leaks and sentences."""
