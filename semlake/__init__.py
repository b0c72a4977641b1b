"""semlake: semantic retrieval and knowledge-base maintenance on Spark DataFrames."""

__version__ = "0.1.0"
