"""Growth forecasting on Spark: features, splits, forecasters and scores as DataFrames."""

import sys

from pyspark import cloudpickle

# task functions travel with their code, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
