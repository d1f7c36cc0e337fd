"""Operators for training-data pipelines, one module each; nothing else in the library needs them.

Functions that run in Python workers are sent by value, so that executors do
not need this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
