"""Training-data operators: extraction, quality, deduplication, privacy, tokens, packing.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames;
its docstring states what it does with nulls, empty and very long texts, ties, repeated
rows, empty tables and extra columns.
"""
