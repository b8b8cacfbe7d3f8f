"""optionlake: option-chain analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Executors receive the functions of this package with the task instead of
# importing it, so a cluster needs no install and no --py-files.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
