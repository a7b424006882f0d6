"""crowdtide: event listings, demand scoring and booking correlation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Python functions travel to the workers by value: no executor needs this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
