"""Spark jobs over coloured 3-D point clouds, declared with the DataFrame API."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
