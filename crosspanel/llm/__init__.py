"""Operators for training-data pipelines: licences, packing, deduplication, decontamination, PII, quality and secrets."""
