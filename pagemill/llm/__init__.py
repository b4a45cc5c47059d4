"""Operators that prepare pages and documents as training text."""
