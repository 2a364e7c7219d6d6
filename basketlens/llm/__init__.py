"""Operators for training-data pipelines: packing, mixing, scoring, scans and deduplication.

Nothing else in the library imports this subpackage. Functions that run in
Python workers are shipped by value, so workers need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
