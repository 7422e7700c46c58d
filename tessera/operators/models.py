"""Models that stay in a worker process: made once, used by all later tasks of the process that ask for the same one."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark import cloudpickle

#: Models that a process keeps; of more, the one that was made first goes.
KEPT = 4
_models: dict[str, object] = {}


def keeper(make: Callable) -> Callable[[], object]:
    """A function for tasks that gives what make() makes. What counts as the same maker is told by its pickled form."""
    key = hashlib.sha1(cloudpickle.dumps(make)).hexdigest()
    return lambda: kept(key, make)


def kept(key: str, make: Callable):
    if key not in _models:
        while len(_models) >= KEPT:
            del _models[next(iter(_models))]
        _models[key] = make()
    return _models[key]
