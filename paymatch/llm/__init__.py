"""Training-data pipeline operators: thirteen DataFrame operators on documents,
web pages, conversations and embeddings. Nothing else in the library imports this package.

Functions that run inside tasks are shipped by value, so executors need no
copy of this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
