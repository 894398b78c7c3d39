"""Objects that live in a Python worker, and task code that travels with the job."""
from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark import cloudpickle

import corpusgate

# Executors need no installed copy of the package: its functions are pickled by value.
cloudpickle.register_pickle_by_value(corpusgate)


def held(name: str, token: str, make: Callable[[], object]) -> object:
    """The object `token` in this worker's place `name`, made at first use. A place holds one object: the next
    token's takes the room of the last."""
    store = sys.modules.setdefault("_corpusgate_worker", types.ModuleType("_corpusgate_worker"))
    place = store.__dict__.setdefault(name, {})
    if token not in place:
        place.clear()
        place[token] = make()
    return place[token]
