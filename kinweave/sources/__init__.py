"""Readers and writers of records, truth, candidate lists and reports."""
