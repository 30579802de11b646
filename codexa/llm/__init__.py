"""Training-data operators: decontamination, deduplication, filtering, classification and mixing.

Nothing else in the library imports this subpackage.
"""
