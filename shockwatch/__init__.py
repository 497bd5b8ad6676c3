"""Shockwatch: attention triage on regular OHLCVA bars, written as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers, and the driver-side worker that prepares stateful streams, need not have this
# package on their path: its functions travel with the job instead of by name.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
