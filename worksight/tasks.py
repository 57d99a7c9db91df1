"""Python code in tasks."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module: str) -> None:
    """Sends what tasks use of this module along with them, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
