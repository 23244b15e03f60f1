"""Training-data operators: tokenising, deduplication, language and quality, mixing.

Each operator takes a DataFrame and returns a new one holding only its own
output columns (the identifier first), so extra input columns, whatever their
names, can never clash with them. ``queries`` registers one query per operator.
"""
