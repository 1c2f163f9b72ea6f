"""Tensor blocks, quantizers and model catalogs as Spark DataFrames."""
