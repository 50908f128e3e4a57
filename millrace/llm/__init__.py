"""Training-data operators: URL filters, extraction, deduplication, mixing, decontamination, scoring, media.

Nothing outside this subpackage imports it.
"""
