"""Readers and writers of files around the vault."""
