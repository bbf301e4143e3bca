"""Whole reports and table maintenance, composed from operators."""
