"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; ``registry`` holds its queries and their SQL.
"""
