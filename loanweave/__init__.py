"""loanweave: linking loan sales to loan purchases with Spark DataFrames."""
