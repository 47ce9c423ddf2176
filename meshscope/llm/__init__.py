"""Operators for preparing language-model training data, and their queries.

Nothing outside this subpackage (but the repository's ``corpus_pipeline.py``
and the guarded registration in ``__spark_entry__.py``) imports it.
"""
