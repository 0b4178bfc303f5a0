"""weft: a PySpark-native graph-analytics engine.

Edge lists become DataFrames, algorithms become declarative supersteps that
Catalyst plans, and iteration lineage is cut in shared storage.
"""
