"""File formats read into and written from DataFrames."""
