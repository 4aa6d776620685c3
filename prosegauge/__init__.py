"""prosegauge: document readability analytics on PySpark.

Functions that run inside Python workers are pickled by value, so executors
need no installed copy of this package (nor a shared working directory).
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
