"""Knowledge retrieval and conversation analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the Python workers by value, so the executors need no
# copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
