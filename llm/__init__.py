"""Operators for training-data pipelines: media columns, BPE, near-dedup, language ID,
chat formatting, toxicity, packing, URL filters, substring dedup and exact top-k search.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
