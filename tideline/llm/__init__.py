"""Operators for building training corpora; nothing else in the library imports them.

Functions that run inside tasks travel with the task, so executors need no
installation of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
