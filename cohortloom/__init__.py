"""Cohort analytics on Spark: labelled cohorts, experiment logs and gridded volumes as DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers carry the code they need, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
