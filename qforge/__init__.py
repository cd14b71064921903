"""qforge: column profiling and multi-target quantile forecasting on Spark.

Everything is expressed with the DataFrame API.  Python only runs inside
Arrow-batched tasks where Spark has no operator (tree histograms, scoring
of large tree sets, geodesic distance) and on the driver for small
metadata (configs, split choice over aggregated histograms).
"""

__version__ = "0.1.0"
