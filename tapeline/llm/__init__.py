"""Training-data operators: filtering, de-duplication, packing, formatting, extraction."""
