"""Comment, search-log, ranking and word-vector analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few functions that run inside tasks travel with the job, so that executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
