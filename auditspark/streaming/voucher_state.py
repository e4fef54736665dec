"""Where each voucher stands, kept as state of a stream of status events, with a timer for those that are stuck.

A voucher's state is its latest event, whatever order events come in. As long as its status is not a final one it waits for `limit`
after it, in event time; then it is told to be stuck, until another event comes. What is told goes out under the number of its
micro-batch, so that one which is run again replaces its own rows.

Vouchers whose ids differ in the lowest bits alone are kept together, as each call for a key costs much more than a voucher does: the
state of a bundle is the list of its vouchers, and its timer is that of the first one that waits. A timer that another event has
overtaken finds nobody due.

Defined cases: of events at the same time the one of the greatest seq is later; rows without a time or id are left out. Events
that come later than `late` behind the latest of the batches before are dropped, as the watermark has passed them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

TOLD = "id long, status string, at timestamp, seq long, stuck boolean"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Bits of an id that a bundle leaves open: it holds at most 256 vouchers.
BUNDLE_BITS = 8


class Standing(StatefulProcessor):
    def __init__(self, limit_ms: int, final: tuple[str, ...]):
        self.limit_ms, self.final = limit_ms, final

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.vouchers = handle.getListState("vouchers", "id long, us long, seq long, status string, waits boolean")

    def _timer(self, us: int) -> int:
        return us // 1000 + self.limit_ms

    def _held(self) -> dict[int, tuple]:
        return {voucher: tuple(latest) for voucher, *latest in self.vouchers.get()}

    def _keep(self, held: dict[int, tuple]) -> None:
        self.vouchers.put([(voucher, *latest) for voucher, latest in held.items()])
        if waiting := [us for us, _, _, waits in held.values() if waits]:
            self.handle.registerTimer(self._timer(min(waiting)))

    def _told(self, some: dict[int, tuple], stuck: bool) -> pd.DataFrame:
        us, seq, status, _ = zip(*some.values())
        return pd.DataFrame({"id": list(some), "status": status, "at": pd.to_datetime(list(us), unit="us"), "seq": seq, "stuck": stuck})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, news = self._held(), {}
        for frame in rows:
            last = frame.sort_values(["us", "seq"], ascending=False).drop_duplicates("id")
            for voucher, us, seq, status in zip(*(last[c].tolist() for c in ("id", "us", "seq", "status"))):
                if voucher not in held or (us, seq) > held[voucher][:2]:
                    held[voucher] = news[voucher] = (us, seq, status, status not in self.final)
        if news:
            self._keep(held)
            yield self._told(news, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, mark = self._held(), timerValues.getCurrentWatermarkInMs()
        due = {voucher: (*latest[:3], False) for voucher, latest in held.items() if latest[3] and self._timer(latest[0]) <= mark}
        if due:
            self._keep(held | due)
            yield self._told(due, True)
        elif waiting := [us for us, _, _, waits in held.values() if waits]:
            self.handle.registerTimer(self._timer(min(waiting)))

    def close(self) -> None:
        pass


def track(events: DataFrame, out: str, checkpoint: str, limit_ms: int, late: str, final: tuple[str, ...]) -> StreamingQuery:
    """Follow a stream of events(id, ts, seq, status) to the end of what is there; tells are written below out."""
    spark = events.sparkSession
    known = events.where("id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    rows = known.select(F.shiftright("id", BUNDLE_BITS).alias("bundle"), "id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), "status")
    told = rows.groupBy("bundle").transformWithStateInPandas(Standing(limit_ms, final), TOLD, "update", "eventTime")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/n={number}")

    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)  # of the stores that there are, the one that keeps timers
    try:
        return told.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE[0], before) if before else spark.conf.unset(STORE[0])


def standing(told: DataFrame) -> DataFrame:
    """id, status, at, stuck: the last that was told of each voucher."""
    last = F.max_by(F.struct("status", "at", "stuck"), F.struct("at", "seq", "stuck")).alias("x")
    return told.groupBy("id").agg(last).select("id", "x.status", "x.at", "x.stuck")


def standing_of(events: DataFrame, limit_ms: int, late: str, final: tuple[str, ...]) -> DataFrame:
    """What track and standing come to, from all events(id, ts, seq, status) at once, of which none came too late."""
    known = events.where("id IS NOT NULL AND ts IS NOT NULL")
    latest = known.groupBy("id").agg(F.max_by(F.struct("status", F.col("ts").alias("at")), F.struct("ts", F.coalesce("seq", F.lit(0)).alias("s"))).alias("x"))
    ends = known.agg((F.max("ts") - F.expr(f"INTERVAL {late}")).alias("mark"))
    waited = F.unix_millis(F.col("x.at").cast("timestamp")) + limit_ms <= F.unix_millis(F.col("mark").cast("timestamp"))
    return latest.select("id", "x", ends.scalar().alias("mark")).select("id", "x.status", "x.at", (~F.col("x.status").isin(*final) & waited).alias("stuck"))
