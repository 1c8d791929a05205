"""Operators for preparing training corpora at cluster scale.

Nothing outside this folder imports it, so the rest of the library works without it.
"""
