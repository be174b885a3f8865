"""Dialogue corpora as Spark tables: episodes, pseudo-labels, factors, probes."""

import sys

from pyspark import cloudpickle

from dialogue_factors.config import Settings

# Tasks receive the package's small helpers by value, so that executors need no
# installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Settings"]
