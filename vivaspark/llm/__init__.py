"""Training-data operators: dedup, tokenisation, scoring, mixing, search and media.

Nothing outside this package imports it.
"""
