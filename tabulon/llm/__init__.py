"""Operators for preparing language-model training data, on DataFrames.

Nothing else in the package imports this subpackage.
"""
