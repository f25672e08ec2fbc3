"""Training-data operators: cleaning, deduplication, scanning, encoding and formatting of documents.

Self-contained: nothing else in the library imports this subpackage.
"""
