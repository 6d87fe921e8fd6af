"""Spark-first semantic-retrieval analytics: scan, chunk, index, tag, search, fold and sync a corpus.

Functions that run in Python workers are pickled by value, so that executors need no copy of this package.
"""

from pyspark import cloudpickle

import scopegrain

cloudpickle.register_pickle_by_value(scopegrain)
