"""Session-cost analytics for coding-agent transcripts, expressed as Spark DataFrames."""
