"""Operators that prepare text for language models.

Nothing outside this package (and its registration in ``__spark_entry__``) imports it.
"""
