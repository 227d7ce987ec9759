"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  Each module holds one operator with a
general interface and the thin ``opN_*`` query that applies it to a whole
table; :mod:`veilmark.llm.registry` lists the queries for the entry module.
"""
