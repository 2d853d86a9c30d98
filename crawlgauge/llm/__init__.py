"""Operators for preparing training data. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value: the workers need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
