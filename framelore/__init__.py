"""Media-timeline analytics on PySpark.

The package's functions travel to executors by value, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
