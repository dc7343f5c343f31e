"""Operators for training-data pipelines over large document tables.

Nothing outside this subpackage (and the top-level ``corpus_pipeline.py``)
imports it.
"""
