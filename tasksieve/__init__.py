"""Text triage on Spark: cleaning, masking, topics, taxonomy, classification."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so that executors need
# not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
