"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it.  Each ``opNN`` module holds one
operator with its own general interface; ``registry`` has the thin queries.
"""
