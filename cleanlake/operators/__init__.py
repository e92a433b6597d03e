"""The computations: DataFrames in, DataFrames out, nothing changed on the way."""
