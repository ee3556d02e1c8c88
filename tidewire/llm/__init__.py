"""Training-data operators: tokenising, scanning, filtering, deduplicating and classifying documents.

Nothing else in the library imports this subpackage.
"""
