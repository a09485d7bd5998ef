"""Batch and streaming jobs over large stores of short, dated, user-owned facts."""
