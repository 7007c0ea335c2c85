"""Training-data operators: decontamination, near-duplicate joins, extraction, packing, token
files, classifiers, embedding dedup and secret scans.  Nothing outside this package imports it."""
