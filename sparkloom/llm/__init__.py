"""Training-data operators: dedup, decontamination, tokenisation, scoring, sharding, formatting."""
