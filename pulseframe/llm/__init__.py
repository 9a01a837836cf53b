"""Operators for large text corpora: filtering, deduplication, decontamination, mixing and sharding.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin queries that the entry point registers.
"""
