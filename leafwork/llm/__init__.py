"""Operators of a training-data pipeline: quality, language, tokens, URLs, duplicates, licences, toxicity, personal data, leaks.

Nothing outside this subpackage imports it.
"""
