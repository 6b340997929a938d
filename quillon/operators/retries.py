"""Calling again what failed for a while."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import TypeVar

Result = TypeVar("Result")


def retried(call: Callable[[], Result], tries: int = 3, wait: float = 0.1, errors: tuple[type[BaseException], ...] = (Exception,), sleep: Callable[[float], None] = time.sleep) -> Result:
    """call(), again after a wait that doubles each time, at most `tries` times."""
    for k in range(tries):
        try:
            return call()
        except errors:
            if k == tries - 1:
                raise
            sleep(wait * 2**k * (1 + random.random() / 10))
    raise AssertionError("unreachable")


def reconnecting(call: Callable[[], Result], reconnect: Callable[[], None], words: tuple[str, ...] = ("token", "expired")) -> Result:
    """call(), once more after reconnect() if its error speaks of an expired token."""
    try:
        return call()
    except Exception as e:
        if not all(w in str(e).lower() for w in words):
            raise
        reconnect()
        return call()
