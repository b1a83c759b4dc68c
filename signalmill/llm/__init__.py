"""Training-data operators: deduplication, decontamination, scoring, packing and search over text corpora.

Nothing outside this subpackage imports it. ``queries.py`` holds the registered queries.
"""
