"""Training-data operators: cleaning, deduplication, tokenisation, packing, search, formatting.

Nothing else in the library imports this subpackage.  ``catalog`` registers one
query per operator; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
