"""millrace: a PySpark-native engine for web-scale text search and graph analytics."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to the workers with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
