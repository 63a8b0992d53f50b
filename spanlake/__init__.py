"""spanlake: span-labelled text corpora as Spark DataFrames."""
