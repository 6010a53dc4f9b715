"""Training-data operators: deduplication, quality, mixing, language-model scoring, tokenising."""
