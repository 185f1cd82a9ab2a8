"""Incremental versions, beyond what batch search stacks offer: latest cells and word counts of a growing table."""
