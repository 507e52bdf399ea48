"""Training-data operators: PII, sharding, quality, toxicity, packing, search, dedup, language, secrets, BPE."""
