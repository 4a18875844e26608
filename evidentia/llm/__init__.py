"""Training-data operators: quality, deduplication, decontamination, counting, packing, scoring.

Nothing outside this subpackage imports it; ``queries.py`` holds its registered queries and SQL.
"""
