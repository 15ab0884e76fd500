"""tableprobe: table profiling and ML-readiness checks as Spark jobs."""

import sys

from pyspark import cloudpickle

# The few functions that run inside tasks travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
