"""termlift: association inference from feature and term annotations, on Spark DataFrames."""
