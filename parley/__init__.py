"""parley - dialogue-evaluation analytics as Spark jobs."""

import sys as _sys

try:  # ship functions defined in this package by value, so Python workers never need it installed
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to shipping the package with --py-files
    pass
