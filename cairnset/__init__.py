"""Search and set algebra over large item collections, on Spark DataFrames."""
