"""Operators for preparing training data: ten operators, their queries and oracle SQL.

Nothing outside this folder imports it, but for the guarded import in
``__spark_entry__.py`` and the pipeline in ``corpus_pipeline.py``.
"""
