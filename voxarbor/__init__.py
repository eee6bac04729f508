"""Spatial and ordered data as DataFrames.

Functions of this package that end up in Python workers travel by value, so
the executors need no copy of it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
