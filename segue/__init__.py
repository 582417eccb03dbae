"""segue: music-library and DJ-set analytics on Spark DataFrames."""
