"""Whole plans: the views over the test tables, the linkage pipeline, and the catalogue of queries."""
