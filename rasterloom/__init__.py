"""A PySpark engine for burst analytics over rasters and for large training corpora."""
