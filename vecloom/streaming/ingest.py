"""Continuous append: each micro-batch is one new version; indexes that no longer cover the table become stale.

``Rebuilder`` rebuilds stale indexes beside whatever else the session does.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame

from vecloom.sources.catalog import Catalog


def append(stream: DataFrame, catalog: Catalog, entity: str, checkpoint: str, rebuild: tuple[str, ...] = ()):
    """Start a query that appends ``stream`` to ``entity`` and rebuilds the named indexes after each batch."""

    def one(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        table = catalog.entity(entity).insert(batch)
        for name in rebuild:
            table.rebuild_index(name)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Rebuilder:
    """A thread that looks for stale indexes every ``pause`` seconds and rebuilds them."""

    def __init__(self, catalog: Catalog, pause: float = 0.5):
        self.catalog, self.pause, self.failed = catalog, pause, []
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def __enter__(self) -> Rebuilder:
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._stop.set()
        self._thread.join()

    def once(self) -> list[str]:
        """Rebuild what is stale now; returns the indexes' names. An index that fails three times is left stale and noted."""
        done = []
        for row in self.catalog.list_entities().collect():
            try:
                done += [f"{row.dbo}.{name}" for name in self.catalog.entity(row.dbo).rebuild_stale()]
            except Exception as e:
                self.failed.append((row.dbo, e))
        return done

    def _run(self) -> None:
        while not self._stop.wait(self.pause):
            self.once()
