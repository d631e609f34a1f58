"""Record linkage and data-processing operators on PySpark DataFrames."""
