"""palimp: auditing, redacting and restructuring document corpora with Spark DataFrames."""
