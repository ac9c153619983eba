"""loomgraph: a Spark-first engine for typed entity graphs, ambiguous mentions and training text."""

__version__ = "0.1.0"
