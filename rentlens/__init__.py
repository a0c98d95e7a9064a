"""Rental-listing analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Ship the few Python helpers with the tasks, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
