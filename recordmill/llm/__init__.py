"""Operators that prepare training corpora, and their registered queries."""
