"""Operators for building training corpora; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
