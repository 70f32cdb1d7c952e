"""Operators of a training-data pipeline: one module per operator, queries in ``queries.py``.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
