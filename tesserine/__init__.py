"""tesserine: keyed and sequence-shaped analytics expressed as Spark DataFrame plans.

Its Python functions travel to the executors by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
