"""evenkeel: event-centred time-series analytics on Spark DataFrames."""
