"""Operators of a training-data pipeline: tokenising, filtering, de-duplication,
mixing, search and language models. Nothing else in the library imports this package.

Functions that run in tasks travel with the task, so executors need not have
this package installed; broadcast values are plain arrays for the same reason.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
