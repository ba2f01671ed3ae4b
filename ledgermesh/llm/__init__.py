"""Training-data operators: quality, mixing, media, licences, dedup, tokens, search, PII, toxicity.

Nothing outside this subpackage imports it.
"""
