"""Snapshot-panel churn analytics as plain Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Arrow functions travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
