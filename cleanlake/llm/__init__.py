"""Operators of a training-data pipeline; each module holds one and its registered query.

What their tasks run is sent by value, so executors need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
