"""Spark-native analytics for evidence-placement question answering.

Functions that run on executors travel by value, so executors need only the public libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
