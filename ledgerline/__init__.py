"""Linked-registry cohort analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from ledgerline.session import build_session

# Functions sent to Python workers travel by value: workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
