"""Functions from DataFrames to DataFrames: queries over ratings, baskets, texts, graphs and streams.

Functions of this package travel to executors by value, so a cluster needs only
PySpark, pyarrow and numpy on its workers, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
