"""Readers and writers for tables, reports, metadata and fitted models."""
