"""Operators for building training corpora from text tables.

Nothing else in the package imports this one.  Functions that run on executors are
pickled by value, so a cluster needs no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
