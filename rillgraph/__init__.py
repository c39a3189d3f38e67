"""rillgraph: analytics on continuously changing graphs, as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are shipped by value, so that executors
# need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
