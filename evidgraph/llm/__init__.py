"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it. ``registry.QUERIES`` and
``registry.ORACLES`` hold what the repository's entry module registers.
"""
