"""Training-data operators: extraction, language, mixing, sharding, duplicates, filters, scoring."""
