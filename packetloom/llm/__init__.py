"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Functions that run in tasks travel with them by value: executors need only the libraries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
