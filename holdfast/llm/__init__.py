"""Operators for training-data corpora; nothing outside this folder imports them.

Functions of this package that run inside tasks are shipped by value, and broadcasts hold
plain data, so executors need PySpark, numpy and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
