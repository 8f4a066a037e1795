"""siftline: retrieval-data construction, ranking evaluation and corpus operators on PySpark."""
import sys

from pyspark import cloudpickle

# Functions of the package travel to the executors by value, so that a cluster need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
