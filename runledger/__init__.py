"""Analytics over the logs of multi-tenant model fine-tuning and serving, on Spark.

Every operator takes DataFrames and returns a DataFrame.  See README.md for the
list and ``runledger.plans.catalog`` for one runnable query per operator.
"""

import sys

from pyspark import cloudpickle

# Python functions of this package travel with the tasks that call them, so the
# executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
