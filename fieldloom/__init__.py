"""Point, raster and voxel analytics planned as Spark DataFrame operations."""

__version__ = "0.1.0"
