"""stemma: catalog, lineage and change-impact analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
