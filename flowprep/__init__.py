"""flowprep: preparing, splitting, encoding and evaluating labelled event tables on Spark.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, so they compose with ``DataFrame.transform`` and Catalyst sees one
plan end to end.
"""

__version__ = "0.1.0"
