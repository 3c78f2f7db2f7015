"""Whole plans: the review table, the scoring pipeline and the registered queries."""
