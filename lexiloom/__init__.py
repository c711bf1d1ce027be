"""Corpus segmentation and vocabulary learning as Spark jobs.

Functions of this package travel to the executors by value, so the package need not be
installed there; what they use (NumPy, pandas, PyArrow) does.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
