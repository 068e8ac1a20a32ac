"""Sequence analytics on Spark: scaling, splitting, windowing, aligning,
forecasting and evaluating many series at once."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the tasks, so nothing
# has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
