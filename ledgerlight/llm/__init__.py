"""Operators for training-data pipelines. Nothing else in the library imports this subpackage.

Task functions are pickled by value, so executors need only Spark, numpy, pandas and pyarrow, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
