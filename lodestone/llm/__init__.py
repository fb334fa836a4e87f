"""Training-data operators: language id, deduplication, packing, tokens, licences,
fingerprints, quality, page text.  Nothing else in the library imports this package."""
