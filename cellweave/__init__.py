"""cellweave: spatial-omics tables (cells, counts, proteins, molecules, studies) as Spark DataFrames."""
