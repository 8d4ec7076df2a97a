"""Spark-native checking of spoken procedures against written checklists.

Functions handed to Python workers are pickled by value, so executors need no
copy of this package on their path.
"""
import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
