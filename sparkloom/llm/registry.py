"""All registered queries of the training-data operators, and their SQL."""

from sparkloom.llm import bpe, chat, decontaminate, exact_dedup, fill_in_middle, hard_negatives, line_dedup, pii, pitman_yor, sharding, simhash, suffix_dedup, toxicity

_MODULES = (bpe, chat, decontaminate, exact_dedup, fill_in_middle, hard_negatives, line_dedup, pii, pitman_yor, sharding, simhash, suffix_dedup, toxicity)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLES", {}).items()}
