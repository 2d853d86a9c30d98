"""Structured Streaming: continuous page audit and regression alerts."""

import sys

from pyspark import cloudpickle

# State processors travel to the executors by value: the workers need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
