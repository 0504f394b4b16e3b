"""Operators that prepare text for training language models.

Nothing outside this folder imports it; ``corpus_pipeline.py`` and ``__spark_entry__.py`` are the only users.
"""
