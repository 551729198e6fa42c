"""Operators for preparing training data (``registry`` lists their queries).

Functions of this package are shipped to the Python workers by value, so the
executors need the libraries they use but not this package on their path.
"""

import sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(sys.modules[__name__])
