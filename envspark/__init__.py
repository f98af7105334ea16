"""envspark: Spark-native environmental-indicator analytics.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
DataFrame / Spark SQL expressions, so Catalyst plans the whole chain
(column pruning, predicate pushdown, one sort per window spec, broadcast of
one-row parameter tables).  Fitted quantities (index bounds, alert
threshold, medians, category dictionaries) are themselves small
DataFrames that are joined back, never Python scalars collected through
the driver, except where a Spark ML estimator needs a literal parameter.
"""

from envspark.session import get_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
