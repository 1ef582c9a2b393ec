"""Operators of training-data pipelines. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Workers need no copy of this package: its functions travel with the tasks that call them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
