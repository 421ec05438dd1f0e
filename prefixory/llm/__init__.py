"""Training-data operators: packing, scoring, filtering, search, encoding, sharding, PII and de-duplication."""
