"""Relational operators over snapshots."""
