"""Operators for preparing training data for language models; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Tasks carry these functions with them: executors need the public packages only, not this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
