"""Operators of a training-data pipeline. Nothing else in the library imports this package.

Functions of this package that run in Python workers are shipped by value, so that executors need
numpy, pyarrow and the tokenizer libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
