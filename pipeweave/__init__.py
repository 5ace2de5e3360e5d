"""Spark-native analytics for planning utility-network connections.

Subpackages: ``plans`` (shared scene and rule tables as SQL), ``operators``
(relational and kernel operators), ``functions`` (scalar column functions),
``sources`` (GeoJSON, CSV and report readers and writers), ``streaming``
(job and upload lifecycles).
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
