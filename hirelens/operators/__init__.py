"""Relational operators on postings and their companions."""
