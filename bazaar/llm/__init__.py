"""Operators for preparing training text at scale.

Nothing else in the library imports this package; ``__spark_entry__`` adds its
queries (``queries.QUERIES``) when it can be imported.
"""
