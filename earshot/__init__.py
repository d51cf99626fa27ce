"""earshot: speech-transcript quality and safety analytics on Spark DataFrames."""
