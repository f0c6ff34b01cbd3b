"""ledgerlink: bank-to-invoice reconciliation and record linkage on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers get the engine's functions with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from ledgerlink.params import Params  # noqa: E402

__all__ = ["Params"]
