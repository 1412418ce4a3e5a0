"""Graph clustering on Spark DataFrames: forests, linkage rounds and k-cuts."""

import sys

from pyspark import cloudpickle

# task functions travel with the job, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
