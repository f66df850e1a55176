"""Training-data operators: personal data, near-duplicates, secrets, quality, archives, language, tokens, packing, decontamination."""
