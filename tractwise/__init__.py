"""Tandem-repeat instability analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so no executor has to have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
