"""cohortspark: cohort and feature analytics as Spark DataFrame operators.

Every public operator takes DataFrames (plus column names / parameters) and
returns a DataFrame. Work is expressed with built-in Spark SQL functions so
Catalyst can prune, push down and code-generate it; small, bounded results
(quantile edges, per-feature statistics) are the only things that reach the
driver.
"""

from cohortspark.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
