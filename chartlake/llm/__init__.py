"""Operators for large training-data pipelines. Nothing outside this package imports it.

Functions of the package that run inside tasks are shipped with the job, so that
executors need no installed copy of it.
"""
from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
