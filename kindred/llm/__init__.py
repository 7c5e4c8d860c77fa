"""Training-data operators: filters, near-duplicates, packing, archives and search over large text corpora.

Nothing outside this package imports it.
"""
