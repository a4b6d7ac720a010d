"""Operators for preparing text and web data to train language models on.

Nothing else in the library imports this subpackage. Its functions travel to the Python workers by value, so
these need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
