"""Personal and device time analytics as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Small helpers run inside Python workers; send them with the task, so that executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
