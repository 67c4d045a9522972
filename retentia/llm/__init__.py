"""Training-data operators: search, deduplication, filtering, archiving,
language-model scoring, packing, chat formatting and tokenization.

Nothing else in the library imports this subpackage.
"""
