"""Operators for preparing language-model training data.

Nothing outside this package imports it. Python code that runs in Spark tasks
is shipped by value, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
