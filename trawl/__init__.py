"""Text and vector retrieval as Spark jobs: DataFrames in, DataFrames out."""
