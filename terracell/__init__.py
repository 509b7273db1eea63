"""terracell: raster and vector analytics as Spark DataFrame plans.

Rasters are DataFrames of cells, vector features are DataFrames of segments, and every
operator is a function from DataFrames to a DataFrame, so Catalyst sees the whole plan.
"""

__version__ = "0.1.0"
