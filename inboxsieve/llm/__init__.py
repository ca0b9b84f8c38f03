"""Operators of a training-data pipeline: fingerprints, mixing, substring and
near-duplicate detection, quality rules and scores, tokenization, chat
formatting, language identification and personal data.

Nothing else in the library imports this subpackage.  ``queries.py`` holds the
thin queries that the driver entry registers.
"""
