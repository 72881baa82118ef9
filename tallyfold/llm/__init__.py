"""Operators of a training-data pipeline over documents and web pages.

Nothing else in the library imports this subpackage. Its functions travel to
the executors with the task (pickled by value), so a job needs no package
installed there beyond Spark's own Python libraries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
