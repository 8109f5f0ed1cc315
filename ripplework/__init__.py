"""ripplework: time-series feature analytics and corpus preparation on Spark DataFrames."""
