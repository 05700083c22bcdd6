"""Operators that prepare training text: cleaning, mixing, deduplication, scoring, decontamination.

No other part of the package imports this one.
"""
