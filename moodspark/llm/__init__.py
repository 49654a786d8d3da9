"""Training-data operators: archives, toxicity, fingerprints, deduplication, tokens and scans."""
