"""Spark-native issue similarity, duplicate detection and corpus preparation."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: functions sent to Python workers travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
