"""Training-data operators: duplicate removal, filters, mixing, scoring, extraction.

Nothing outside this package imports it.
"""
