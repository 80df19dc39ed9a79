"""Operators over texts for language-model training data."""
