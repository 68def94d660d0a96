"""Tamarack: a search and analytics engine written as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so that executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
