"""railweave: rail-network and itinerary analytics on Spark DataFrames."""
