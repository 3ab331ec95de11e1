"""Attempts that may fail for a while: a queue of retries with backoff as state of a stream, kept across restarts.

An attempt ends well, fails for good (no retry would mend it), or fails for now. Only failures for good reach the rejects; what
failed for now waits in the state and is tried again when its timer is due, later each time. Up to ``PACK`` items that
were read together travel and wait as one row of lines (what crosses to the state and back costs by rows), and packs are dealt
to shards by a hash of all of them, so a key with many items is spread no worse than others. A shard's queue is one list state
with one timer, and packs that end at once touch no state.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DONE, GONE, LATER = "done", "gone", "later"
#: An item's fields and the number of the attempt (from 1) to DONE, GONE or LATER.
Attempt = Callable[[dict, int], str]
#: Items of a pack: JSON, a line each (JSON has no line feed of its own).
PACK = 200
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def delay(tries: int, first: int, most: int) -> int:
    """Milliseconds to wait after so many failed attempts: doubled each time, up to ``most``."""
    return min(most, first << min(tries - 1, 40))


class Retries(StatefulProcessor):
    """The queue of one shard: (due, tries, item) of all that failed for now, and a timer for the earliest.

    ``item`` holds the lines of a pack; those of them that end alike go on as one row, the others wait as one.
    """

    def __init__(self, attempt: Attempt, first: int, most: int):
        self.attempt, self.first, self.most = attempt, first, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getListState("queue", "due bigint, tries int, item string")

    def _try(self, items: Iterable[tuple[int, str]], now: int, waiting: list[tuple]) -> Iterator[Row]:
        for tries, lines in items:
            ended: dict[str, list[str]] = {}
            for item in lines.split("\n"):
                ended.setdefault(self.attempt(json.loads(item), tries + 1), []).append(item)
            if later := ended.pop(LATER, None):
                waiting.append((now + delay(tries + 1, self.first, self.most), tries + 1, "\n".join(later)))
            for outcome, done in ended.items():
                yield Row(item="\n".join(done), outcome=outcome, tries=tries + 1)

    def _wake(self, due: int, now: int) -> None:
        """A timer for ``due`` unless an earlier one will go off; one that is going off just now is still listed."""
        if not any(now < t <= due for t in self.handle.listTimers()):
            self.handle.registerTimer(due)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        waiting: list[tuple] = []
        now = timerValues.getCurrentProcessingTimeInMs()
        yield from self._try(((0, r["item"]) for r in rows), now, waiting)
        if waiting:
            self.queue.appendList(waiting)
            self._wake(min(waiting)[0], now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        queue = list(self.queue.get()) if self.queue.exists() else []
        waiting = [q for q in queue if q[0] > now]
        yield from self._try(((q[1], q[2]) for q in queue if q[0] <= now), now, waiting)
        if waiting:
            self.queue.put(waiting)
            self._wake(min(waiting)[0], now)
        else:
            self.queue.clear()

    def close(self) -> None:
        pass


def with_retries(items: DataFrame, attempt: Attempt, first: int = 60_000, most: int = 3_600_000, shards: int = 1024) -> DataFrame:
    """A stream of items as one of item (JSON), outcome (done or gone) and tries.

    The session must keep its state in RocksDB (``PROVIDER``). ``shards`` is fixed for the life of a checkpoint.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(["\n".join(lines[lo : lo + PACK]) for lo in range(0, len(lines), PACK)], pa.string())], names=["item"])

    packs = items.select(F.to_json(F.struct(*items.columns)).alias("item")).mapInArrow(packed, "item string")
    dealt = packs.select(F.pmod(F.xxhash64("item"), F.lit(shards)).alias("shard"), "item")
    settled = dealt.groupBy("shard").transformWithState(Retries(attempt, first, most), "item string, outcome string, tries int", "append", "ProcessingTime")
    return settled.select(F.explode(F.split("item", "\n")).alias("item"), "outcome", "tries")


def run_settled(outcomes: DataFrame, out: str, rejects: str, checkpoint: str, every: str = "200 milliseconds", limit: float = 600.0) -> StreamingQuery:
    """Run until all files are read and nothing waits, then stop: done items as Parquet in ``out``, those gone in ``rejects``.

    After ``limit`` seconds it stops too; what still waits stays in the checkpoint for the next run.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for wanted, path in ((DONE, out), (GONE, rejects)):
            batch.where(F.col("outcome") == wanted).drop("outcome").write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    query = outcomes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    until = time.monotonic() + limit
    while query.isActive and time.monotonic() < until:
        time.sleep(0.1)
        if query.exception():
            break
        progress = query.lastProgress
        if progress and progress.numInputRows == 0 and progress.stateOperators and progress.stateOperators[0].numRowsTotal == 0:
            break
    query.stop()
    if query.exception():
        raise query.exception()
    return query
