"""Conversation memory on Spark: store, search and summarise memories as DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package travel inside the tasks that call them, so that executors need
# no copy of it.
register_pickle_by_value(sys.modules[__name__])
