"""Queries over the test tables, their SQL twins and a comparison tool."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
