"""Operators for preparing training text, with their queries; nothing else in the library uses them.

Functions that run in tasks travel with the task, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
