"""Training-data operators: deduplication, decontamination, scans, classifiers, media and tokenizers.

Nothing outside this subpackage imports it.
"""
