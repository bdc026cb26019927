"""Operators of a training-data pipeline; see each module's docstring. Nothing else in the library imports this."""
