"""Percentages over time, on streams and on tables alike."""
