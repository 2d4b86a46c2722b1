"""Operators for preparing training text. Nothing outside this folder imports them."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no copy of this folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
