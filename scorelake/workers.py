"""Objects that stay in a Python worker: models that take long to load, and are wanted by one task after the other.

A function that Spark sends to the workers is pickled with what it encloses, so what it keeps in an enclosed table is gone with the task. This module isn't enclosed: workers import it, and its table lives as long as
their process. Names tell objects apart, so the same name must stand for the same object.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")

#: Objects that a worker keeps; the one that wasn't wanted for longest goes.
MOST = 2
_held: OrderedDict[str, object] = OrderedDict()


def held(name: str, make: Callable[[], T]) -> T:
    """The worker's object of this name; made, if it has none. What make raises is raised each time."""
    if name not in _held:
        while len(_held) >= MOST:
            _held.popitem(last=False)
        _held[name] = make()
    _held.move_to_end(name)
    return _held[name]
