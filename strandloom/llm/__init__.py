"""Operators for preparing training text: one module per operator, queries in ``queries``.

Nothing else in the library imports this package.  Its functions travel with the plan, so executors
need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
