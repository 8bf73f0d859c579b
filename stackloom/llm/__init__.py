"""Training-data operators: deduplication, search, scoring, archives, tokens.

Each module holds one operator with its general interface; ``registry`` turns
them into the registered ``opN_<name>`` queries. Nothing else in the library
imports this package.
"""
