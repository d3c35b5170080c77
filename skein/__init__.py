"""Skein: analytics over agent trajectories as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
