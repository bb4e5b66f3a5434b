"""Operators that prepare training data from large collections of documents."""
