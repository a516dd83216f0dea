"""Training-data operators: deduplication, scanning, scoring, tokenising and packing at corpus scale."""
