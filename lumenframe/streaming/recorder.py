"""A tracker that a solver on the driver talks to: messages wait in a bounded queue and are appended to the store's event table."""

from __future__ import annotations

import json
import time
from collections import deque
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from ..plans.run import save_solution
from ..sources.store import SCHEMAS, Store


class Recorder:
    """Takes messages without ever making the solver wait: beyond ``most`` waiting ones new ones are dropped and counted.

    An epoch's end, a snapshot and close() write what waits, as one append.
    """

    def __init__(self, store: Store, most: int = 8192, snapshot_seconds: float = 60.0):
        self.store, self.most, self.snapshot_seconds = store, most, snapshot_seconds
        self.waiting: deque[tuple] = deque()
        self.dropped, self.epoch, self.open = 0, 0, True
        last = store.table("tracker_events").agg({"seq": "max"}).first()[0]
        self.seq = 0 if last is None else int(last) + 1
        self.last_snapshot = float("-inf")

    def put(self, op: str, value: float | None = None, done: int | None = None, total: int | None = None) -> bool:
        """Queues a message; false where it was dropped."""
        if not self.open or len(self.waiting) >= self.most:
            self.dropped += 1
            return False
        self.waiting.append((self.seq, datetime.now(UTC).replace(tzinfo=None), op, self.epoch, None if value is None else float(value), done, total))
        self.seq += 1
        return True

    def flush(self) -> int:
        """Appends what waits; the number of messages."""
        rows = [self.waiting.popleft() for _ in range(len(self.waiting))]
        if rows:
            self.store.write("tracker_events", self.store.spark.createDataFrame(rows, SCHEMAS["tracker_events"]).coalesce(1), mode="append")
        return len(rows)

    def on_batch_rmse(self, rmse: float) -> None:
        self.put("rmse_batch", rmse)

    def on_progress(self, done: int, total: int) -> None:
        self.put("progress", done=done, total=total)

    def on_epoch_end(self, epoch: int, rmse: float) -> None:
        self.epoch = epoch
        self.put("epoch_end", rmse)
        self.flush()

    def set_meta(self, **entries: object) -> None:
        """Notes for readers of the events; they are part of the metadata."""
        self.store.set_metadata(**{f"tracker.{k}": v for k, v in entries.items()})

    def set_prior(self, weights: dict[int, float]) -> None:
        self.set_meta(orbit_weights=json.loads(json.dumps({str(k): float(v) for k, v in weights.items()})))

    def maybe_snapshot(self, weights: DataFrame, rmse: float, force: bool = False) -> bool:
        """Saves a snapshot if the last one is long enough ago."""
        now = time.monotonic()
        if not force and now - self.last_snapshot < self.snapshot_seconds:
            return False
        self.last_snapshot = now
        last = self.store.table("solution").where("run_id = 'snapshot'").agg({"epoch": "max"}).first()[0]
        save_solution(self.store, "snapshot", weights, 0 if last is None else int(last) + 1, rmse, of_epoch=self.epoch)
        self.put("x_snapshot", rmse)
        self.flush()
        return True

    def save(self, weights: DataFrame, rmse: float) -> None:
        """The final solution."""
        save_solution(self.store, "last", weights, self.epoch, rmse, source="tracker")
        self.put("save_x", rmse)
        self.flush()

    def close(self) -> int:
        """Writes what waits and takes no more; the number of messages that were dropped in all."""
        self.flush()
        self.open = False
        return self.dropped
