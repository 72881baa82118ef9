"""Reports and jobs: functions from DataFrames to DataFrames."""
