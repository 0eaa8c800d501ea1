"""Operators on tables of documents, chapters, segments, plans, versions and task runs."""
