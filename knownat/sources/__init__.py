"""Landed files to tables and back."""
