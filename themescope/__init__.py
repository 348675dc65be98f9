"""themescope: explore large tables of short texts with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Task functions travel to executors whole, so the package itself need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
