"""Training-data operators. Self-contained: nothing outside this subpackage imports it.

Functions that run in Python workers are pickled by value, so executors need no copy of this package.
"""

import importlib
import sys

from pyspark import cloudpickle

MODULES = ("shared", "hashing", "sharding", "topk", "ann", "bpe", "neardup", "langid", "secrets", "mixing", "licenses", "quality")

for _name in MODULES:
    importlib.import_module(f"{__name__}.{_name}")
    cloudpickle.register_pickle_by_value(sys.modules[f"{__name__}.{_name}"])
