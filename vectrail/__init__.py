"""vectrail: text corpora to searchable vectors, expressed as Spark jobs.

``functions``  Column -> Column building blocks (cleaning, chunking, vectors, messages)
``sources``    corpora, files and message logs as DataFrames
``operators``  DataFrame -> DataFrame work (joins, keyed writes, search, metrics)
``streaming``  Structured Streaming jobs built from the operators
``plans``      one runnable query per operator, each with its SQL counterpart
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
