"""Event chains that arrive out of order: early events wait until the gap before them closes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenfold.operators import chain

EVENT = "stream string, seq long, id string, type string, ts string, payload string, prev_id string, prev_hash string, hash string"
OUT = "stream string, seq long, code string"


BLOCK = 256  # numbers of a stream that are kept as one value


class _Early:
    """Early events of a stream in the state store, a block of numbers as one JSON text; what is loaded is written back by `save`."""

    def __init__(self, state) -> None:
        self.state, self.held, self.changed = state, {}, set()

    def block(self, n: int) -> dict[str, list]:
        if n not in self.held:
            value = self.state.getValue((n,))
            self.held[n] = json.loads(value[0]) if value else {}
        return self.held[n]

    def has(self, seq: int) -> bool:
        return str(seq) in self.block(seq // BLOCK)

    def put(self, seq: int, event: list) -> None:
        self.block(seq // BLOCK)[str(seq)] = event
        self.changed.add(seq // BLOCK)

    def take(self, seq: int) -> list | None:
        event = self.block(seq // BLOCK).pop(str(seq), None)
        if event is not None:
            self.changed.add(seq // BLOCK)
        return event

    def save(self) -> None:
        for n in self.changed:
            if self.held[n]:
                self.state.updateValue((n,), (json.dumps(self.held[n]),))
            elif self.state.containsKey((n,)):
                self.state.removeKey((n,))
        self.held, self.changed = {}, set()

    def blocks(self) -> Iterator[tuple[int, dict[str, list]]]:
        """Every block as it is in the store, one after the other."""
        for key, value in self.state.iterator():
            yield key[0], json.loads(value[0])


class _Chain(StatefulProcessor):
    """Per stream: the last event accepted, the early ones by blocks of numbers, and one timer, for the earliest ts of these.

    When the watermark has passed an early event, what is missing before it will not come: the gap is told and the
    chain goes on from the earliest that waits.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, id string, hash string, timer long")
        self.early = handle.getMapState("early", "block long", "events string")

    def _state(self) -> tuple[tuple, int | None]:
        *last, timer = self.last.get() if self.last.exists() else (0, None, None, None)
        return tuple(last), timer

    def _accept(self, key, before, seq: int, event, after_gap: bool) -> tuple[tuple, list]:
        id_, prev_id, prev_hash, hash_, sound, _ = event
        codes = [] if sound else ["hash"]
        if not after_gap:
            codes += ["previous-id"] if prev_id != before[1] else []
            codes += ["previous-hash"] if prev_hash != before[2] else []
        return (seq, id_, hash_), [(key[0], seq, c) for c in codes or ["ok"]]

    def _go_on(self, key, last: tuple, early: _Early) -> tuple[tuple, list]:
        """Take early events as long as they follow."""
        out = []
        while (event := early.take(last[0] + 1)) is not None:
            last, rows = self._accept(key, last, last[0] + 1, event, False)
            out += rows
        return last, out

    def _timer(self, timer: int | None, at: int | None) -> int | None:
        """The stream's timer, moved to `at` if that is earlier."""
        if at is None or (timer is not None and timer <= at):
            return timer
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)
        return at

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        (last, timer), early = self._state(), _Early(self.early)
        for frame in rows:  # frame by frame: what is early goes into the state store, not into memory
            out, earliest = [], None
            for seq, *event in frame[["seq", "id", "prev_id", "prev_hash", "hash", "sound", "at_ms"]].sort_values("seq", kind="stable").itertuples(index=False):
                seq, event = int(seq), [None if v is None or v != v else v for v in event]
                event = [*event[:4], bool(event[4]), int(event[5])]
                if seq == last[0] + 1 and not early.has(seq):
                    last, rows_out = self._accept(key, last, seq, event, False)
                    out += rows_out
                elif seq <= last[0] or early.has(seq):
                    out.append((key[0], seq, "repeated"))
                else:
                    early.put(seq, event)
                    earliest = event[5] if earliest is None else min(earliest, event[5])
            last, more = self._go_on(key, last, early)
            early.save()
            timer = self._timer(timer, earliest)
            yield pd.DataFrame(out + more, columns=["stream", "seq", "code"])
        self.last.update((*last, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (last, _), early = self._state(), _Early(self.early)
        due, watermark, top, numbers = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs(), 0, []
        for n, events in early.blocks():
            numbers.append(n)
            top = max([top, *(int(seq) for seq, e in events.items() if e[5] <= max(due, watermark))])
        for n in sorted(numbers):  # everything up to the last event that is due, and what follows it without a gap
            out = []
            for seq in sorted(map(int, early.block(n))):
                gap = seq > last[0] + 1
                if gap and last[0] >= top:
                    break
                if gap:
                    out.append((key[0], last[0] + 1, "gap"))
                last, rows = self._accept(key, last, seq, early.take(seq), gap)
                out += rows
            early.save()
            yield pd.DataFrame(out, columns=["stream", "seq", "code"])
            if last[0] < (n + 1) * BLOCK - 1 and last[0] >= top:
                break
        left = [min(e[5] for e in events.values()) for _, events in early.blocks() if events]
        self.last.update((*last, self._timer(None, min(left, default=None))))

    def close(self) -> None:
        pass


def event_lines(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """A stream of the events in a folder's NDJSON files; a line that is no event has null fields."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", True).json(folder)


def chain_report(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(stream, seq, code) of a stream of events in any order, each once: `ok`, or what is wrong with it (`hash`, `previous-id`, `previous-hash`),
    `repeated` for a number that was there before, and `gap` at the first number of a run that did not come.

    An event that is early waits; it waits no longer once the watermark, `delay` behind the latest ts of all, has passed
    its own ts. What comes after its gap was told is `repeated`, unless it is itself behind the watermark, when it is dropped. Events without a stream, a number or a ts are left out.
    """
    timed = events.withColumn("at", F.try_to_timestamp("ts")).where("stream IS NOT NULL AND seq IS NOT NULL AND at IS NOT NULL")
    timed = timed.withColumn("sound", F.coalesce(F.col("hash") == chain.digest(), F.lit(False))).withWatermark("at", delay)
    rows = timed.select("stream", "seq", "id", "prev_id", "prev_hash", "hash", "sound", "at", F.unix_millis("at").alias("at_ms"))
    return rows.groupBy("stream").transformWithStateInPandas(statefulProcessor=_Chain(), outputStructType=OUT, outputMode="Update", timeMode="EventTime")
