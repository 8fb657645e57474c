"""Operators of a training-data pipeline: near-duplicates, extraction, quality, URL rules,
repeated passages, decontamination, chat rendering, vector search, personal data, tokens.

Nothing else in the library imports this subpackage.
"""
