"""rivulet: recommendation and behaviour analytics over interaction tables, on Spark.

Every public operator takes DataFrames and returns a DataFrame; nothing is
collected to the driver except bounded model state (k centroids, partition
offsets).  See README.md for the operator map.
"""

from rivulet.session import build_session, shared_path

__all__ = ["build_session", "shared_path"]
