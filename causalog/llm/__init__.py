"""Operators of a training-data pipeline over document tables.

One module per operator; ``registry`` holds the thin registered queries and their SQL.
Nothing outside this package imports it.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
