"""Training-data operators: formatting, tokenising, filtering, deduplication, search and packing.

Nothing outside this folder imports it.
"""
