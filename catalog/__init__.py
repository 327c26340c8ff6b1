"""Catalogue: every operator as a query on the star-schema tables, with its check in SQL."""
