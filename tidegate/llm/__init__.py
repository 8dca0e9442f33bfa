"""Training-data operators: quality, archives, duplicates, language, chat, leaks, toxicity, scoring, tokens."""
