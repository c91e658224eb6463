"""Operators for preparing training text: ten jobs over documents and pages."""
