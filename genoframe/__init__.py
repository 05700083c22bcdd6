"""Bioinformatics analytics on Spark DataFrames.

Every operation is a function from DataFrames to DataFrames that declares a plan
and leaves the physical strategy to Spark.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
