"""Operators for preparing large text corpora.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
