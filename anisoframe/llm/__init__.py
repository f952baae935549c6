"""Training-data operators: deduplication, extraction, filtering, archives and tokenization.

Nothing outside this package imports it; the rest of the library works without it.
"""
