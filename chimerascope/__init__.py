"""Structural consequences of gene fusions, annotated as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors with the job, so that they needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
