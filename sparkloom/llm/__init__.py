"""Operators for preparing text corpora: deduplication, archives, fingerprints, filters, formatting and tokens.

Nothing outside this subpackage imports it, apart from the query registry at the top of the repository.
"""
