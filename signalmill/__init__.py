"""Text-signal analytics on Spark."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions with the tasks, so they need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
