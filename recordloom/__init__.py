"""Recordloom: Spark-native analytics over structured binary records."""

import sys

from pyspark import cloudpickle

# Executors get functions of this package by value, so it needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
