"""Operators for building training data at scale.  Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# functions that run in executors travel with the job, so executors need no installed copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
