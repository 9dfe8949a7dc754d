"""Operators of a training-data pipeline: tokens, mixing, fingerprints,
sharding, deduplication, nearest neighbours, toxicity, secrets.

Nothing else in the library imports this package. Functions that run inside
Spark tasks travel by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
