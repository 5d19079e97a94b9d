"""Operators for large text corpora: scanning, labelling, deduplicating, packing and archiving documents."""
