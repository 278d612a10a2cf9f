"""Operators on large text tables for training data; nothing else in the library imports this subpackage."""
