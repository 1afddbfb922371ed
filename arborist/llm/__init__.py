"""Training-data operators: classifiers, packing, deduplication, scoring and scans over whole document tables.

Nothing outside this subpackage imports it.
"""
