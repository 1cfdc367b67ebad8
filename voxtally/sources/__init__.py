"""Readers of survey folders, workbooks and vocabularies, and the CSV writer."""
