"""matchflow: football tracking and event analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# executors need not have this package: its functions travel with the tasks
cloudpickle.register_pickle_by_value(sys.modules[__name__])
