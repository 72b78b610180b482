"""Operators for training-data pipelines. Nothing else in the library imports this subpackage.

Functions that run in Python tasks are shipped by value, so that executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
