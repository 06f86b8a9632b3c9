"""pairweave: entity resolution and corpus preparation as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions travel with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
