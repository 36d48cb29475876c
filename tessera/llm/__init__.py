"""Operators for building training corpora: tokenising, mixing, filtering, deduplicating and searching.

Nothing outside this folder imports it. ``queries`` and ``oracle_sql`` in
``tessera.llm.queries`` are what the driver entry point registers.
"""
