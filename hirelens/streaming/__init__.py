"""Continuous landing of collection drops."""
