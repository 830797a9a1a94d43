"""tidewatch: passive-DNS and threat-intelligence analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers carry their own code, so
# executors need neither this folder nor an installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
