"""Operators for training data: search, deduplication, filtering, mixing, packing and token files."""

import sys
from importlib import import_module
from pkgutil import iter_modules

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors themselves, which need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

for _module in iter_modules(__path__):
    import_module(f"{__name__}.{_module.name}")

from quillwork.llm.registry import LLM_ORACLES, LLM_QUERIES  # noqa: E402

__all__ = ["LLM_ORACLES", "LLM_QUERIES"]
