"""Corpus operators for training-data pipelines (one module per operator).

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
