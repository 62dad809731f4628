"""Operators for cleaning and preparing training data (URL filters to BPE)."""
