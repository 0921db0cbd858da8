"""Operators for large training corpora: fingerprints, dedup, PII, packing, classifiers, tokens, HTML, search."""
