"""Website-audit analytics on Spark DataFrames.

Functions sent to Python workers are pickled by value, so that executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
