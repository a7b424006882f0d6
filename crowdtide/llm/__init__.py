"""Operators of a training-data pipeline; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Python functions travel to the workers by value, so that no executor needs this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
