"""Spark-native analytics over facilities, hierarchical cells and road graphs."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors whole, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
