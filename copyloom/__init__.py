"""copyloom: how many copies of repeated sequence each sample carries, measured with Spark DataFrames."""
