"""quarrywork: document and telemetry analytics as PySpark jobs."""

import sys

from pyspark import cloudpickle

# The package's functions travel to the Python workers by value, so a worker needs no copy
# of the package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
