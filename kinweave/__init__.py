"""kinweave: record linkage and corpus analytics on PySpark DataFrames."""
