"""Training-data operators: PII, BPE, near-dedup, toxicity, exact top-k, secret
scans, packing, language ID, quality rules and binary token output."""
