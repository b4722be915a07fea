"""Operators of a training-data pipeline: tokenisation, deduplication, filtering.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
