"""Operators of a training-data pipeline: near copies, quality, search, secrets, decontamination, toxicity, archives, packing."""
