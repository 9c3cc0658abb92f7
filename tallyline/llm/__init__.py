"""Training-data operators: each module holds one operator and its method.

Nothing outside this folder imports it; ``queries.py`` registers the queries
and ``sql.py`` their DuckDB counterparts.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so that workers
# need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
