"""Operators for large-scale training-data preparation.

Nothing else in the package imports this subpackage; the queries that apply
its operators to whole tables are in :mod:`pairforge.llm.queries`.
"""
