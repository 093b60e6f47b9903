"""Scalable record matching on Spark: similarity self-joins over DataFrames."""

import sys

from pyspark import cloudpickle

# Ship the package's own functions with the tasks, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
