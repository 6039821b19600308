"""rasterweave: neighbourhood analytics on rasters, written for Spark DataFrames."""

from rasterweave.session import get_spark

__all__ = ["get_spark"]
