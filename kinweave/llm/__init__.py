"""Operators for training corpora: language, tokens, pages, scores, personal data, copies, mixing, sharding."""
