"""Sequential raster kernels in numpy; no Spark in here."""
