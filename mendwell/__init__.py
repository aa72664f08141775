"""Spark operators for data pipelines that watch, diagnose and mend themselves."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Send the small helpers that run in Python workers along with their tasks, so
# that executors do not need this package installed or on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
