"""Operators for building language-model training corpora.

Nothing outside this folder imports it.  ``registry`` lists its queries.  Functions that run on executors are sent
whole, so the executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
