"""A PySpark-native engine for text quality, similarity and training-data preparation."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
