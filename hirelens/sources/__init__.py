"""Landed payloads in, normalised postings out; one module per kind of source."""
