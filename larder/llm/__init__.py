"""Training-data operators: dedup, sharding, toxicity, tokens, decontamination, archives.

Nothing else in the library imports this subpackage.
"""
