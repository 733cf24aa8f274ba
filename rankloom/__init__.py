"""rankloom: listwise-ranking analytics on Spark DataFrames.

The package is pickled by value, so that executors need no copy of it on their
own disks.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
