"""Operators for preparing language-model training data."""

import sys

from pyspark import cloudpickle

# Tasks get these functions with the query: workers need not find the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
