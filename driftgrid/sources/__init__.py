"""Catalogue, readers and writers of the tables in schemas.py."""
