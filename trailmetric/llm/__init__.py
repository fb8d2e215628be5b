"""Training-data operators: dedup, tokenisation, filtering, packing, search.

Self-contained: nothing outside this folder imports it, and it imports nothing
from the rest of the package.  ``queries.py`` binds each operator to its table.
"""
