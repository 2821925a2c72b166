"""Training-data operators: cleaning, de-duplication, scoring, packing and formatting."""
