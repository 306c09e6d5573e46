"""pothi: a Spark-native engine for page-anchored documents."""

import sys

from pyspark import cloudpickle

# Functions sent to workers go by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
