"""Analytics on web-request threat data."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
