"""Training-data operators: fingerprints, deduplication, language, extraction, quality, packing, tokens.

Every operator takes and returns DataFrames; `queries.py` registers one query per operator.
Nothing else in the library imports this subpackage.
"""
