"""A PySpark-native engine that cleans, checks and curates text corpora."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions by value, so it need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_RECORDS = ("clean_record", "check_record", "clean_and_check")


def __getattr__(name: str):
    """The record functions, loaded when first used."""
    if name in _RECORDS:
        from .kernels import records

        return getattr(records, name)
    raise AttributeError(name)
