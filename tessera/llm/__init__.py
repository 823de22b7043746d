"""Training-data operators: packing, token ledgers, deduplication, filtering, archives.

Nothing outside this subpackage imports it.
"""
