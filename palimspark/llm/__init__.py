"""Training-data operators: search, near-dedup, scoring, mixing, filtering, tokenising.

Nothing outside this subpackage imports it.
"""
