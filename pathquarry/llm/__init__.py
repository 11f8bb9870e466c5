"""Operators for large training-data pipelines (dedup, packing, search, scanning, scoring).

Nothing outside this subpackage imports it.  Each module documents its own
null, empty, tie and duplicate behaviour.
"""
