"""Operators of a training-data pipeline: filters, deduplication, tokenisation
and packing of large document tables. Nothing outside this subpackage imports
it; ``queries.py`` and ``oracle.py`` hold its registered queries."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to executors by value, which therefore
# need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
