"""A PySpark-native engine for source-tree facts: lookup, search, graphs, deltas, alignment and briefings."""
