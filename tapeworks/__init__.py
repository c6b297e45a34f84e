"""Market-microstructure analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Step functions travel to the executors by value, so no package has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
