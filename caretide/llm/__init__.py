"""Operations for training-data pipelines: scans, filters, models, deduplication and packing."""
