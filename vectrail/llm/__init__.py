"""Operators for building training corpora: dedup, decontamination, extraction, tokenisation, scoring."""
