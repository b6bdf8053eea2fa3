"""Operations of a training-data pipeline: filters, deduplication, encoding, packing and sharding.

Nothing outside this subpackage imports it.
"""
