"""Project-risk analytics on Spark: rules, schedules, graphs and signals as DataFrames."""
