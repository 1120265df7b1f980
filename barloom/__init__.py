"""barloom: a Spark-first engine for market-bar research and corpus preparation."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so that executors need no
# copy of this package on their own import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
