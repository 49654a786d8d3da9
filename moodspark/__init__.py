"""moodspark: cohort-level text and chart analytics as composable DataFrame transforms."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need no copy of the package: functions travel with their code. What runs
# there names functions and classes of the package, never its modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
