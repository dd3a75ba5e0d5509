"""Training-data operators: deduplication, filtering, extraction and tokenisation of text corpora.

Nothing else in the library imports this subpackage.  Its functions are pickled by value, so
executors need no copy of the repository on their path.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
