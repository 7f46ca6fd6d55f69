"""bookspark: messy sales exports to audited analyses, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from bookspark.session import get_session

__all__ = ["get_session"]

# Functions handed to Spark travel whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
