"""Incremental work: the leased queue and windowed event streams."""
