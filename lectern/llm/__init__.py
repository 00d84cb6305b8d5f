"""Operators for preparing training data at corpus scale.

Nothing outside this package imports it; it can be removed without touching
the rest of the library.
"""
