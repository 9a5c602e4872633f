"""Operators for training data made for language models. Nothing else in the library imports this subpackage."""
