"""A PySpark-native engine for document and assessment processing."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the workers by value, so that executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
