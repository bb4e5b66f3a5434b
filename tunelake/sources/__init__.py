"""Readers and writers for JSON Lines, training logs and versioned datasets."""
