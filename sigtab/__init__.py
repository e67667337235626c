"""Spark-native analytics; task functions of this package travel to the workers by value, so these need no copy of it."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
