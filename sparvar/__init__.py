"""Rare-variant annotation and association analytics on Spark DataFrames.

Every public function maps DataFrames to DataFrames.  The few that have to run
an action (small driver-side solves, convergence loops) say so in their
docstring.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
