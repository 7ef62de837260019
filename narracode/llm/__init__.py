"""Operators that prepare training text: near-duplicates, packing, scoring, personal data.

Their functions travel to the executors by value, so workers need not have this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
