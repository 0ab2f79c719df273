"""Operators that a large training-data pipeline needs beside text cleaning.

Nothing else in the library imports this subpackage.
"""
