"""spanloom: event, interval and table analytics over noisy observations, as Spark DataFrames."""
