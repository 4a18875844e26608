"""Evidence analytics and acquisition-fact processing on Spark DataFrames."""
