"""Spark-first analytics for bilingual, segment-structured document archives.

Functions that run inside Python workers are shipped by value, so executors do
not need this package on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
