"""Document retrieval and answer evaluation on tables, for Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the plan, so they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
