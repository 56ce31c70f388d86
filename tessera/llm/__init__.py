"""Operators for preparing language-model training data.

Nothing outside this package imports it.  Every module holds one operator;
``queries`` registers the thin ``opN_*`` queries over them.
"""
