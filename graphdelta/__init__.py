"""graphdelta: change analytics between snapshots of a weighted graph, on Spark DataFrames."""

__version__ = "0.1.0"
