"""Operations of a training-data pipeline: packing, filters, deduplication, token counts, sharding.

Nothing else in ``sigspark`` imports this subpackage; it may be removed whole.
"""
