"""Formula analytics and training-data operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
