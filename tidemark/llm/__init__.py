"""Training-data operators: de-duplication, filtering, sharding, search and token output.

Nothing outside this folder imports it.  Each module is one operator with its
own interface; ``queries`` holds the thin registered queries over the tables.
"""
