"""Linkage plans built from the operators."""
