"""Emenda: correction and preparation of text at corpus scale, on Spark DataFrames."""

from pyspark import cloudpickle

# Functions of this package travel to the executors inside the tasks that use them, so a cluster
# needs no installed copy.
cloudpickle.register_pickle_by_value(__import__(__name__))
