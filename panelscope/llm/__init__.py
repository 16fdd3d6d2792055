"""Operators of a training-data pipeline: tokenising, filtering, near
duplicates, formatting, archives. Nothing else in the library imports this
subpackage."""
