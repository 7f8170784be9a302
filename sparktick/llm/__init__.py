"""Training-data operators: dedup, search, sharding, packing, formatting, filtering, fingerprints and tokenisation."""
