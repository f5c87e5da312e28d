"""pagemill: document-structure analytics on Spark DataFrames.

Functions that run in Python workers are sent by value, so the package has to be
installed on the driver only.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
