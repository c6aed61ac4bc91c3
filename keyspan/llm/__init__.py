"""Operators for preparing training text at scale. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
