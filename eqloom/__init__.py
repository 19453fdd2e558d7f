"""eqloom: a PySpark engine that turns scientific documents into tables of equations,
passages, definitions and graded relations."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
