"""Polling: looking for new rows every so often, where a source can't tell of its changes."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from quillon.streaming import events
from quillon.streaming.listener import affected

if TYPE_CHECKING:
    from quillon.database import Database


class Poller:
    """Finds inserts only, as ids that weren't seen before.

    With a source, its rows whose ids the table lacks are added to the table. Without one the table
    itself is read anew, as it is where it is attached. Then the table's listeners predict for what
    lacks outputs, so a poll that failed half way is made good by the next one.
    """

    def __init__(self, db: Database, table: str, source: Callable[[], DataFrame] | None = None, period: float = 30.0, on_error: Callable[[Exception], None] | None = None):
        self.db, self.table, self.source, self.period, self.on_error = db, table, source, period, on_error
        self.behind = True
        self.started, self.stopped = threading.Event(), threading.Event()
        self.thread: threading.Thread | None = None

    def poll(self) -> int:
        """One look; returns how many rows were added."""
        added = 0
        if self.source is not None:
            known, key = self.db.table(self.table), self.db.primary_id(self.table)
            new = self.db.stable(events.new_rows(self.source(), known, key))
            added = new.count()
            if added:
                self.behind = True
                self.db.store.append(self.table, new)
        if self.behind or self.source is None:
            for x in affected(self.table, self.db.listeners):
                x.run(self.db)
            self.behind = False
        return added

    def _loop(self) -> None:
        self.started.set()
        while not self.stopped.is_set():
            try:
                self.poll()
            except Exception as e:  # the next look makes good what this one left
                self.behind = True
                if self.on_error:
                    self.on_error(e)
            self.stopped.wait(self.period)

    def start(self) -> Poller:
        if self.thread is not None and self.thread.is_alive():
            raise RuntimeError("it runs already")
        self.stopped.clear()
        self.thread = threading.Thread(target=self._loop, daemon=True, name=f"poll-{self.table}")
        self.thread.start()
        self.started.wait()
        return self

    def stop(self, timeout: float | None = None) -> None:
        """Ends after the look that is under way."""
        self.stopped.set()
        if self.thread is not None:
            self.thread.join(timeout)
