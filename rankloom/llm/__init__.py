"""Training-data operators: URL filtering, archives, deduplication, decontamination, scoring, packing.

Nothing outside this package imports it; the queries of these operators are in ``queries``.
"""
