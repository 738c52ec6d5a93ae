"""Training-data operators: search, cleaning, de-duplication, decontamination, extraction and packing of documents."""
