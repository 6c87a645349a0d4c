"""Secret scanning, redaction and text-corpus operators on Spark DataFrames."""
