"""Operators for preparing training text: scoring, duplicate removal,
decontamination, counting, mixing and chat formatting."""

import sys

from pyspark import cloudpickle

# Functions of this package travel inside the tasks that run them, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
