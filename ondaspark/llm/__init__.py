"""Training-data operators: cleaning, deduplication, tokenising, sharding and scoring of document tables.

Nothing outside this subpackage imports it. Every operator takes a DataFrame
with ``doc_id`` and ``text`` (other columns are ignored or passed through, as
its docstring says) and returns a DataFrame.
"""
