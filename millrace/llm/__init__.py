"""Operators for building training corpora: repair, near-duplicates, page cleaning, leakage, mixing, sentences."""
