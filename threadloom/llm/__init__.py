"""Operators for preparing training data from conversation corpora.

Nothing outside this subpackage imports it.
"""
