"""tessera: retrieval, graph, memory and training-data operators as Spark plans."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package travel to the workers with the plan, so executors need not have it installed.
register_pickle_by_value(sys.modules[__name__])
