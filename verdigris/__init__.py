"""Verdigris: indicator scoring, evidence analytics and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors by value, so a cluster needs no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
