"""Spark-native anomaly detection and incident evidence over daily KPI series.

Every operator is a function from DataFrames to a DataFrame; nothing here runs
an action unless its docstring says so.
"""

import sys

from pyspark import cloudpickle

# Task-side helpers travel inside the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
