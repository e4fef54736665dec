"""Spark-native analytics for audit vouchers, knowledge bases and text corpora."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are shipped by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
