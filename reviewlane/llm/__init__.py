"""Training-data operators: scans, deduplication, formatting, tokenizing, sharding.

Nothing outside this package imports it. Python kernels are shipped to executors by
value, so a cluster needs no copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
