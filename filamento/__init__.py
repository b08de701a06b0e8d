"""Spark-first analytics over disclosure text, filings and point-in-time panels."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: its functions travel with the tasks that use them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
