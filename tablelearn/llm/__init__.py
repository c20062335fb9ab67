"""Operators for preparing language-model training data.

Each module holds one operator with a general DataFrame interface;
``queries`` registers one query per operator over the shared tables.
"""
