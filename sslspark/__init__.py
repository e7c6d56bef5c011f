"""sslspark: semi-supervised / open-set labelling operators on Spark DataFrames.

Every operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function built from Spark SQL expressions, windows, joins and aggregates,
so Catalyst plans it and the work is spread over the cluster.
"""

__all__ = ["session", "constants"]
