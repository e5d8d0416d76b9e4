"""Operators for preparing training text of language models.

One module per operator; ``queries`` applies each of them to the given tables.
Nothing else in the library imports this package.
"""
