"""Equity-panel analytics on Spark: long tables in, long tables out."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Tasks get this package's functions with their code, so executors need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
