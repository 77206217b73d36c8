"""Operators for preparing language-model training data: mixing, filters, de-duplication, packing, sharding.

Nothing else in the library imports this package. Operators that must tell rows apart never rely on ``doc_id``:
ids may be null or repeat, so rows are known by their place in a stored block (``blocks``) or carried whole.
"""
