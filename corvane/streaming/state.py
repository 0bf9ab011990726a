"""Keyed state machines over event time: a cache whose entries expire, and documents that pass through stages.

Each is a processor of Structured Streaming with state in RocksDB and event-time timers, beside a batch form in windows that gives
the same rows for the same events. Rows of a key are taken by time within a micro-batch; a key's rows of one micro-batch meet in
one task, so sources bound their batches. Times are microseconds since 1970, `seq` orders events of one time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CACHE_ROW = "key string, seq bigint, at bigint, outcome string, document string, fetched bigint"
STAGE_ROW = "key string, seq bigint, at bigint, stage string, progress int, error string"


def micros(ts: Column) -> Column:
    """Microseconds since 1970, of times without a zone as they stand."""
    return F.unix_micros(ts.cast("timestamp")) if not isinstance(ts, str) else F.unix_micros(F.col(ts).cast("timestamp"))


def _by_time(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r["at"], r["seq"]))


class Cache(StatefulProcessor):
    """Entries of a key by document, each until ttl after it was last stored."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "document string", "fetched bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = {d[0]: v[0] for d, v in self.entries.iterator()}
        changed = set()
        for r in _by_time(rows):
            alive = {d: t for d, t in held.items() if t <= r["at"] < t + self.ttl}
            document = r["document"]
            if document is not None:
                outcome, fetched = "refreshed" if document in alive else "created", r["at"]
                if held.get(document, r["at"]) <= r["at"]:
                    held[document] = r["at"]
                    changed.add(document)
            else:
                document, fetched = max(alive.items(), key=lambda x: (x[1], x[0]), default=(None, None))
                outcome = "hit" if document is not None else "miss"
            yield Row(key=key[0], seq=r["seq"], at=r["at"], outcome=outcome, document=document, fetched=fetched)
        for document in changed:
            self.entries.updateValue((document,), (held[document],))
            self.handle.registerTimer((held[document] + self.ttl) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for d in [d[0] for d, v in self.entries.iterator() if v[0] + self.ttl <= now]:
            self.entries.removeKey((d,))
        return iter(())

    def close(self) -> None:
        pass


def cached(events: DataFrame, *, ttl: int, delay: str = "0 seconds", time: str = "ts") -> DataFrame:
    """A stream (key, seq, at, document, and its event time) -> what each event meets, as CACHE_ROW.

    A row with a document stores it: created, or refreshed where the same document is held and has not expired, which starts its
    time anew. A row without one looks the key up: a hit on the document stored last, if it was less than `ttl` microseconds ago,
    else a miss. Expired entries are never seen, and their state goes once the watermark has passed them.
    """
    rows = events.withWatermark(time, delay)
    return rows.groupBy("key").transformWithState(statefulProcessor=Cache(ttl), outputStructType=CACHE_ROW, outputMode="Append", timeMode="EventTime")


def cached_as_of(events: DataFrame, *, ttl: int) -> DataFrame:
    """The rows of `cached` in batch: each lookup meets the last store before it, each store the last of its document."""
    order = Window.partitionBy("key").orderBy("at", "seq")
    last = F.last(F.when(F.col("document").isNotNull(), F.struct("document", F.col("at").alias("fetched"))), ignorenulls=True).over(order)
    before = F.lag("at").over(Window.partitionBy("key", "document").orderBy("at", "seq"))
    out = events.select("key", "seq", "at", "document", last.alias("last"), F.when(F.col("document").isNotNull(), before).alias("before"))
    fresh = F.coalesce(F.col("last.fetched") + ttl > F.col("at"), F.lit(False))
    stores = F.col("document").isNotNull()
    outcome = F.when(stores, F.when(F.col("before") + ttl > F.col("at"), "refreshed").otherwise("created")).otherwise(F.when(fresh, "hit").otherwise("miss"))
    return out.select("key", "seq", "at", outcome.alias("outcome"), F.when(stores | fresh, F.col("last.document")).alias("document"), F.when(stores | fresh, F.col("last.fetched")).alias("fetched"))


class Stages(StatefulProcessor):
    """The stage a key has reached, since when, and whether that is its last."""

    def __init__(self, progress: dict[str, int], limit: int, failed: str):
        self.progress, self.limit, self.failed = progress, limit, failed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reached = handle.getValueState("reached", "progress int, since bigint, ended boolean")

    def _late(self, key, since: int) -> Row:
        return Row(key=key[0], seq=-1, at=since + self.limit, stage=self.failed, progress=100, error="stage_timeout")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        progress, since, ended = self.reached.get() if self.reached.exists() else (-1, None, False)
        began = since
        for r in _by_time(rows):
            if ended:
                break
            if since is not None and r["at"] > since + self.limit:
                ended = True
                yield self._late(key, since)
                break
            step = 100 if r["stage"] == self.failed else self.progress.get(r["stage"], -1)
            if r["stage"] != self.failed and step <= progress:
                continue  # unknown stages and steps back are refused
            progress, since, ended = step, r["at"], step == 100
            yield Row(key=key[0], seq=r["seq"], at=r["at"], stage=r["stage"], progress=step, error=r["error"])
        self.reached.update((progress, since, ended))
        if since is not None and since != began and not ended:
            self.handle.registerTimer((since + self.limit) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        progress, since, ended = self.reached.get()
        if not ended and (since + self.limit) // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.reached.update((progress, since, True))
            yield self._late(key, since)

    def close(self) -> None:
        pass


def staged(events: DataFrame, *, progress: dict[str, int], limit: int, failed: str = "failed", delay: str = "0 seconds", time: str = "ts") -> DataFrame:
    """A stream (key, seq, at, stage, error, and its event time) -> accepted transitions, as STAGE_ROW.

    `progress` gives the stages and how far along each is; the one at 100 ends a key, and so does `failed`. Only steps forward are
    accepted. A key that stays in a stage for more than `limit` microseconds of event time has failed then, with the error
    stage_timeout and seq -1, even if no more of its events come: a timer says so once the watermark is there.
    """
    rows = events.withWatermark(time, delay)
    return rows.groupBy("key").transformWithState(statefulProcessor=Stages(progress, limit, failed), outputStructType=STAGE_ROW, outputMode="Append", timeMode="EventTime")


def staged_as_of(events: DataFrame, *, progress: dict[str, int], limit: int, now: Column, failed: str = "failed") -> DataFrame:
    """The rows of `staged` in batch, at event time `now` (milliseconds): accepted are the new heights of progress; the first end
    or the first gap beyond the limit closes a key."""
    order = Window.partitionBy("key").orderBy("at", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    known = F.create_map(*[x for s, p in progress.items() for x in (F.lit(s), F.lit(p))])
    out = events.withColumn("step", F.when(F.col("stage") == failed, 100).otherwise(F.coalesce(F.try_element_at(known, F.col("stage")), F.lit(-1))))
    height = F.coalesce(F.max("step").over(before), F.lit(-1))
    out = out.withColumn("height", height).where((F.col("height") < 100) & ((F.col("step") > F.col("height")) | (F.col("stage") == failed)))
    gap = F.coalesce(F.col("at") - F.lag("at").over(order) > limit, F.lit(False))
    out = out.withColumn("gap", gap).withColumn("gaps", F.sum(F.col("gap").cast("int")).over(order)).where("gaps = 0 OR (gaps = 1 AND gap)")
    taken = out.where("gaps = 0")
    late = F.struct(F.lit(-1).cast("long").alias("seq"), (F.col("last.at") + limit).alias("at"), F.lit(failed).alias("stage"), F.lit(100).alias("progress"), F.lit("stage_timeout").alias("error"))
    last = out.groupBy("key").agg(F.max(F.when(F.col("gaps") == 0, F.struct("at", "seq", "step"))).alias("last"), F.max("gaps").alias("gaps"))
    ends = last.where((F.col("gaps") > 0) | ((F.col("last.step") < 100) & (F.floor((F.col("last.at") + limit) / 1000) + 1 <= now))).select("key", late.alias("x")).select("key", "x.*")
    return taken.select("key", "seq", "at", "stage", F.col("step").alias("progress"), "error").unionByName(ends)
