"""Transcript quality and correction analytics as Spark DataFrame operators.

Every public function takes and returns DataFrames or Columns and stays lazy;
nothing is collected unless its docstring says so and names the bound.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Kernels travel to the workers by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
