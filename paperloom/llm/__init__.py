"""Operators for building training data for language models; nothing else in the package imports this folder."""
