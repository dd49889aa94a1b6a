"""Operations for large text corpora: licences, extraction, decontamination, toxicity, tokens, archives, quality, dedup."""
