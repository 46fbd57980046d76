"""Analytics over mixed uploads (CSV, relational tables, documents, agent logs) as plain Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
