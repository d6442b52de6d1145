"""Operators of a training-data pipeline: extraction, quality, duplicates, tokens, decontamination, personal data.

Nothing outside this folder imports it. Every operator is a function of DataFrames; the registered queries that
apply them to whole tables are in ``queries``.
"""
