"""Training-data operators: deduplication, decontamination, PII, tokenisation, quality, language, chat."""
