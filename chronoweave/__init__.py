"""chronoweave: temporal pattern analytics on Spark.

The package is pickled by value into Python workers, so executors need no
installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
