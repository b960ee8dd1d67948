"""Spindrift: a PySpark-native catalogue analytics and recommendation engine."""

import sys

from pyspark import cloudpickle

# Functions of the library travel to the executors by value: they need not have it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
