"""Readers, sinks and small fixed dimensions."""

import sys

from pyspark import cloudpickle

# Data sources travel to the executors by value: the workers need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
