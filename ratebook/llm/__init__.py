"""Training-data operators (decontamination, extraction, sharding, dedup, scoring, tokenising).

Nothing outside this subpackage imports it; its queries are in ``queries``.
"""
