"""Training-data operators: packing, sharding, counting, deduplication, search, decontamination and scoring.

Nothing outside this subpackage imports it.
"""
