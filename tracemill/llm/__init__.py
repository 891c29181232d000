"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it; the entry module adds its queries only
when the folder is present.
"""
