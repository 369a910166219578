"""Streams with a life of their own: events that open, are taken back and expire without a new row; and a fan-out whose cursor
lies beside what it has written."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TRANSITION = "event_id string, status string, at timestamp"


class _Life:
    """One event: its claims by (source, place, class), each with the instant it was made, and until when it holds."""

    def __init__(self, claims: dict[str, list[int]] | None = None, live: bool = False):
        self.claims, self.live = claims or {}, live

    def until(self) -> int:
        return max((c[1] for c in self.claims.values()), default=0)

    def expire(self, now: int) -> Iterator[tuple[str, int]]:
        if self.live and self.until() <= now:
            at, self.claims, self.live = self.until(), {}, False
            yield "expired", at

    def take(self, kind: str, source: str, place: str | None, threat: str | None, at: int, valid: int) -> Iterator[tuple[str, int]]:
        yield from self.expire(at)
        if kind == "assert":
            own = self.claims.setdefault(json.dumps([source, place, threat]), [at, 0])
            own[0], own[1] = max(own[0], at), max(own[1], valid)
            if not self.live and self.until() > at:
                self.live = True
                yield "opened", at
            return
        # a withdrawal names a place and a class, or means all of its source's
        for key, (made, _) in list(self.claims.items()):
            s, p, t = json.loads(key)
            if s == source and place in (None, p) and threat in (None, t) and made <= at:
                del self.claims[key]
        if self.live and self.until() <= at:
            self.claims, self.live = {}, False
            yield "withdrawn", at


def event_lifecycle(facts: DataFrame, delay: str = "60 minutes") -> DataFrame:
    """Transitions (event_id, status, at) of events: opened by an assertion that nothing held before, withdrawn when a
    withdrawal leaves no claim, expired when the last claim's time has passed, by event time and without another row.

    facts: a stream of (event_id, kind assert or withdraw, source_id, location_id, threat_type, at, valid_until). A claim is
    kept for each source, place and class; saying it again prolongs it and never shortens it; a withdrawal takes back what
    its source said no later, of the place and class that it names, or of all where these are null. Rows of one instant count
    in the order assert, withdraw. What comes later than the watermark's delay is dropped, as the event may have expired. A
    key's state are its living claims; it goes when the event ends. Null events are an event like others."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        life, out = _Life(*json.loads(state.get[0])) if state.exists else _Life(), []
        if state.hasTimedOut:
            out += life.expire(state.getCurrentWatermarkMs() * 1000)
        rows = pd.concat(list(batches)) if not state.hasTimedOut else pd.DataFrame()
        if len(rows):
            for r in rows.sort_values(["at", "kind", "source_id"], kind="stable").itertuples(index=False):
                null = lambda x: None if pd.isna(x) else x
                out += life.take(r.kind, null(r.source_id), null(r.location_id), null(r.threat_type), r.at.value // 1000, 0 if pd.isna(r.valid_until) else r.valid_until.value // 1000)
        if life.live:
            state.update((json.dumps([life.claims, True]),))
            state.setTimeoutTimestamp(max(life.until() // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({"event_id": [key[0]] * len(out), "status": [s for s, _ in out], "at": pd.to_datetime([a for _, a in out], unit="us")})

    return facts.withWatermark("at", delay).groupBy("event_id").applyInPandasWithState(step, TRANSITION, "claims string", "append", GroupStateTimeout.EventTimeTimeout)


class FanOut:
    """Rows of a log, in order of their ids, made into deliveries and written under `target`; for foreachBatch.

    The cursor is the highest id whose deliveries are written. A batch skips what lies at or below it, writes the rest to a
    folder named by where it begins, and then moves the cursor. One that fails before it has moved is written over when it
    runs again, and one that begins anew from a lost checkpoint skips what is there: each delivery is there once, and no
    table is read for it. Ids that come after higher ones are not delivered: feed the contiguous run of a log."""

    def __init__(self, spark: SparkSession, target: str, expand: Callable[[DataFrame], DataFrame], id_col: str = "id"):
        self.spark, self.target, self.expand, self.id_col = spark, target.rstrip("/"), expand, id_col

    def position(self) -> int:
        """The cursor; -1 before the first row."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.target}/cursor")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return -1
        # a cursor counts with the mark of success that its write has ended with
        ended = [s.getPath() for s in files.listStatus(path) if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((int(p.getName().partition("=")[2]) for p in ended), default=-1)

    def write(self, batch: DataFrame, _: int) -> None:
        done = self.position()
        new = batch.where(F.col(self.id_col) > done)
        last = new.agg(F.max(self.id_col).alias("m")).first().m
        if last is None:
            return
        self.expand(new).write.mode("overwrite").parquet(f"{self.target}/deliveries/from={done + 1}")
        self.moved(last)

    def moved(self, last: int) -> None:
        self.spark.range(1).select(F.lit(last).alias("position")).write.mode("overwrite").parquet(f"{self.target}/cursor/up_to={last}")

    def deliveries(self, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.target}/deliveries")
