"""breachline: network-compromise reachability on Spark DataFrames."""
