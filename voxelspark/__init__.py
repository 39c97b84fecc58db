"""voxelspark: image and volume analytics on Spark DataFrames."""
