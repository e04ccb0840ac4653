"""Spark analytics over image annotations, label rasters and saved model outputs."""
