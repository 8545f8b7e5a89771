"""Training-data operators: scans, scoring, deduplication, decontamination and packing.

Nothing else in the library imports this subpackage.
"""
