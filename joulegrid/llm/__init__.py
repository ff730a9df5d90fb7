"""Training-data operators: search, packing, language, tokens, near-copies, privacy and quality."""
