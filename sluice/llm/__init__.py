"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it: the query engine works the same
with the folder removed.  ``queries.py`` holds the thin registered queries.
"""
