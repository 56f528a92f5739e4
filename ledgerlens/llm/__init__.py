"""Operators for large-scale training-data preparation.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.  Each
operator takes DataFrames and column names, selects only the columns it needs
first (so extra columns with clashing names do no harm), and documents its
result for nulls, empty texts, ties, repeated rows and empty tables.
"""
