"""Data profiling, cleaning, validation and preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel whole, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
