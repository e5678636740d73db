"""Operators of a training-data pipeline: filters, duplicates, decontamination, mixing, scoring."""
