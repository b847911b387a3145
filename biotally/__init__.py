"""Community diversity analytics on Spark."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: its functions travel with their tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
