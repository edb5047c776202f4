"""Training-data operators: mixing, secret scan, quality model, media columns,
packing, exact and near dedup, page extraction, n-gram scoring, licence scan.

Nothing outside this subpackage imports it.
"""
