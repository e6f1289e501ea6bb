"""Operators of a training-data pipeline over the ``documents`` and ``embeddings`` tables.

Nothing else in the library imports this subpackage. Each module holds one operator with
a general interface; ``queries.py`` holds the thin registered queries and their SQL.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage that run in tasks are sent with the task, so executors need
# not have the library installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
