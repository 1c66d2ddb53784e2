"""Training-data operators: sharding, scans, extraction, labelling, packing, near-duplicates.

Nothing outside this subpackage imports it.
"""
