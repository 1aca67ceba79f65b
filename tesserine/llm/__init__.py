"""Operators of a training-data pipeline over text, vectors and urls.

Nothing outside this subpackage imports it.  Its Python functions travel to
the executors by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
