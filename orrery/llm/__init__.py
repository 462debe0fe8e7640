"""Training-data operators: secrets, sharding, search, language, dedup, tokens, toxicity, packing, fingerprints.

Nothing else in the library imports this subpackage; ``registry`` lists its queries.
"""
