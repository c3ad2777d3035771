"""voltaic — regional energy analytics on Spark DataFrames.

Layers: ``sources`` (landed files and tables in, sinks out), ``functions``
(column expressions), ``operators`` (DataFrame -> DataFrame building blocks),
``plans`` (bindings of the operators to concrete tables and the query
registry), ``streaming`` (Structured Streaming versions of the ingest path).
"""

__version__ = "0.1.0"
