"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Functions that run on executors
are pickled by value, so a worker needs only the third-party libraries, not
this package on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
