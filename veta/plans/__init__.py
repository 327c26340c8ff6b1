"""Whole flows composed from the operators: cleaning, linear track, logistic track."""
