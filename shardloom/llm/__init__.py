"""Training-data operators: scoring, deduplication, search, decontamination and materialisation.

Nothing outside this subpackage imports it.
"""
