"""Retrieval and context analytics over tables of queries, passages, threads and call logs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The few functions that run in Python workers travel with their jobs, so executors need no installed package.
register_pickle_by_value(sys.modules[__name__])
