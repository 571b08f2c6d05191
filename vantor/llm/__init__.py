"""Training-data operators: mixing, filtering, scoring and deduplication of documents.

Nothing outside this subpackage imports it.
"""
