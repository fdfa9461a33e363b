"""Operators for the preparation of training text: secrets, fingerprints, shards, URLs, scores, neighbours, copies, packing, tokens."""
