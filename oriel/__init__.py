"""oriel: leakage-safe evaluation of probabilistic forecasts on Spark DataFrames."""
