"""Training-data operators: dedup, token counts, licences, language, PII, mixing, search."""
