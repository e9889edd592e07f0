"""Whole runs and the reports over their results."""
