"""Training-data operators: packing, filters, searches, deduplication, tokenising and media columns.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface over any DataFrame of documents; ``queries`` applies them to the test tables.
"""
