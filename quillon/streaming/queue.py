"""Events that wait for their consumer, table by table."""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Callable
from typing import Any


class Queue:
    """publish() puts events into the list of their table; drain() hands each list to its consumer
    once, in order, while further events may already come in."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._lists: dict[str, list[Any]] = defaultdict(list)

    def publish(self, table: str, *events: Any) -> None:
        with self._lock:
            self._lists[table] += events

    def drain(self, consume: Callable[[str, list[Any]], None]) -> int:
        """How many events were handed over. Events of a consumer that fails stay."""
        done = 0
        for table in list(self._lists):
            with self._lock:
                events = self._lists.pop(table, [])
            if not events:
                continue
            try:
                consume(table, events)
            except Exception:
                with self._lock:
                    self._lists[table] = events + self._lists[table]
                raise
            done += len(events)
        return done

    def __len__(self) -> int:
        return sum(map(len, self._lists.values()))
