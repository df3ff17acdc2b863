"""Training-data operators: packing, deduplication, similarity join, coding, mixing, filtering, extraction.

Nothing outside this package imports it.  ``queries`` holds the thin contract queries.
"""
