"""Operators for preparing large text corpora on Spark.

Nothing else in the library imports this subpackage; ``catalog`` registers its
queries and ``corpus_pipeline`` (repository top) chains five of its operators.
"""
