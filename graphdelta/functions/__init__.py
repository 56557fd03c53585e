"""Scalar column expressions built from pyspark.sql.functions."""
from .scalar import *  # noqa: F401,F403
