"""Operations of training-data pipelines: tokenising, mixing, deduplication, scoring and token files."""
