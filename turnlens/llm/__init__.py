"""Operators for building language-model training data. Nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# tasks carry their own code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
