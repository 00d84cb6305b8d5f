"""Scalar functions on columns: text keys, identifiers, citations, digests."""
