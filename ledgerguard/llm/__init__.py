"""Operators of a training-data pipeline, one module each (see README, "Training-data operators").

The functions that run in Python workers are sent to them by value, so executors need no copy of this
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
