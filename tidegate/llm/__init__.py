"""Operators for preparing training text at scale.

Nothing outside this package imports it.  Each module holds one operator with a
general interface; :mod:`tidegate.llm.queries` holds the thin ``opN_*`` queries.
"""
