"""Media-timeline analytics on Spark: operators that take and return DataFrames."""
import sys

from pyspark import cloudpickle

# Executors need not have the package installed: its functions travel with the tasks that call them
cloudpickle.register_pickle_by_value(sys.modules[__name__])
