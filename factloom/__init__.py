"""factloom - code and text intelligence expressed as Spark DataFrame queries."""

import sys

from pyspark import cloudpickle

# Ship the functions that run inside tasks with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
