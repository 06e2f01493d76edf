"""Code-review analytics over many repositories, written as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code with them, so that executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
