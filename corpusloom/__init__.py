"""Text-corpus production and analysis on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Arrow functions of this package travel to the workers by value: no install on the executors is needed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
