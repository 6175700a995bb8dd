"""Training-data operators: mixing, scoring, tokenising, archiving, near-duplicates and search.

Nothing outside this subpackage imports it.
"""
