"""Operators of a training-data pipeline: sharding, near-duplicates, mixing, decontamination, filters and scores."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks carry this code along; executors need no install
