"""voxtally: survey free-text analytics as PySpark DataFrame transforms."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with the job, so that executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
