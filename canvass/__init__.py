"""Catalogue search, eligibility matching and publishing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so nothing needs to be
# installed or shipped there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
