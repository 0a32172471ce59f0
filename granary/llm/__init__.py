"""Training-data operators (deduplication, filtering, tokenizing, sharding, scoring).

Nothing outside this subpackage imports it; removing the folder leaves the
rest of the library working.
"""
