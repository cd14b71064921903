"""Training-data operators: one module each, queries in ``queries``.

Nothing else in the library imports this subpackage.
"""
