"""Training-data operators: packing, tokenizing, filtering, extraction, near-duplicate work.

Nothing outside this subpackage imports it.
"""
