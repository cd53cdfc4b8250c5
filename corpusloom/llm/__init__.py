"""Operators of a training-data pipeline: filters, duplicate removal, packing, sharding, encoding and search."""
