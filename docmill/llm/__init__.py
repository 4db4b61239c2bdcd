"""Training-data operators (packing, near-duplicates, toxicity, secrets, mixing, media, search, sharding, LM scores, URL lists).

Nothing else in the library imports this subpackage.
"""
