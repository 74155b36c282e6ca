"""Training-data operators: packing, scoring, dedup, decontamination and search on Spark DataFrames."""
