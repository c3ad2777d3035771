"""Training-data operators: ten operators over ``documents`` / ``pages`` / ``benchmark`` / ``labels``.

Each module holds one operator with its own general interface; ``queries.py``
binds them to the driver's tables. Nothing outside this package imports it.
"""

import sys

from pyspark import cloudpickle

# Functions of this package run in Python workers that need not have it installed:
# ship them with the task by value (also covers the modules of the package).
cloudpickle.register_pickle_by_value(sys.modules[__name__])
