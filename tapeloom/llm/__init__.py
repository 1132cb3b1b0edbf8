"""Operations of a training-data pipeline: token counts, near-duplicates, secrets, formatting, rules, search, packing, scoring, encoding."""
