"""Operators for building training data. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are sent with the tasks, so executors need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
