"""Readers of wire formats and writers of answers."""
