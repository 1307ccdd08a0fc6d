"""Graph recall and corpus preparation on PySpark."""

import sys

from pyspark import cloudpickle

# functions that run on executors are sent whole, so the executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
