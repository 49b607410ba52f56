"""Signal forensics, byte-stream analysis and table operators on Spark DataFrames."""
