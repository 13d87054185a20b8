"""Operators for building training data from text, one module per operator.

Nothing else in the library imports this package.
"""
