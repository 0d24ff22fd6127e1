"""Operations for training-data pipelines: counting, scoring, scanning, deduplicating and archiving text."""
