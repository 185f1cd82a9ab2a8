"""A cache for pure functions that travels to the workers by value, as ``functools.lru_cache`` doesn't."""

from __future__ import annotations

from collections.abc import Callable


def memo(limit: int = 100_000) -> Callable:
    """Remembers results by positional arguments; emptied when it holds ``limit`` of them."""

    def wrap(function: Callable) -> Callable:
        seen: dict = {}

        def call(*args):
            try:
                return seen[args]
            except KeyError:
                if len(seen) >= limit:
                    seen.clear()
                out = seen[args] = function(*args)
                return out

        call.__doc__ = function.__doc__
        return call

    return wrap
