"""Training-data operators: deduplication, decontamination, scanning, scoring, mixing and rendering."""
