"""Whole appraisals, and the operators laid out over the given tables."""
