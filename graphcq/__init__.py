"""graphcq: conjunctive queries over edge-labelled directed graphs, on Spark DataFrames."""

__version__ = "0.1.0"
