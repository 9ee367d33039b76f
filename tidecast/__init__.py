"""tidecast: daily service-ticket volumes, forecasts and reconciliation on Spark."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

# Functions sent to executors carry their code, so a cluster needs no copy of this package.
register_pickle_by_value(sys.modules[__name__])
