"""Training-data operators: one module per operator, registered in ``queries``."""

import sys

from pyspark import cloudpickle

# Functions for executors travel with their code, so that no machine needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
