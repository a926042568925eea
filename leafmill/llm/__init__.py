"""Training-data operators (decontamination, scoring, extraction, dedup, PII, ...).

Nothing else in the package imports this subpackage.
"""
