"""Operators for preparing text corpora: deduplication, filtering, scoring, mixing, packing.

Nothing outside this package imports it. Each module holds one operator with a
general interface; ``queries`` registers the thin ``opN_*`` queries over the
driver tables.
"""
