"""Training-data operators: tokenizing, packing, filtering, near-duplicate and archive work at corpus scale.

Nothing outside this package imports it.
"""
