"""Operators for preparing training text, and the queries that apply them.

Nothing else in the library imports this subpackage. Functions of it that run
in Python workers travel by value, so workers need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
