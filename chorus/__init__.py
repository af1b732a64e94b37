"""chorus: short-text (comment) analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` (usable through
``df.transform``) built from Spark's own joins, aggregates, windows and ML
stages, so the same code runs on a laptop or a cluster.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.2.0"

# Functions that run inside tasks travel with their code: a Python worker
# needs no copy of this package on its own path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
