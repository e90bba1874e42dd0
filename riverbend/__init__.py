"""riverbend: a Spark-first engine for multivariate time series and event streams."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

#: Functions that run on executors travel with their code, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
