"""caseweave: rate and spatial-concentration analytics over event line lists, on Spark DataFrames."""
