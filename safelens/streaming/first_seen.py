"""Keep-first over a stream: of the events of a key, one in every so much time, in the order of their own time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that ``transformWithState`` needs; set it before a query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def kept_of(events: list[tuple[int, str]], last: int | None, horizon: int) -> tuple[list[tuple[int, str]], int | None]:
    """(kept, time of the last kept) of events (time, row) in order: one is kept if more than the horizon has passed since the last kept."""
    kept = []
    for at, row in sorted(events):
        if last is None or at - last > horizon:
            kept.append((at, row))
            last = at
    return kept, last


def _processor(horizon: int) -> StatefulProcessor:
    class FirstSeen(StatefulProcessor):
        """Events wait until the watermark has passed them, so that none can come before; a key's state ends a horizon after its last kept event."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "at bigint, row string")
            self.last = handle.getValueState("last", "at bigint")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            first = None
            for frame in rows:
                pairs = list(zip(frame["at_ms"].tolist(), frame["as_json"].tolist(), strict=True))
                self.waiting.appendList([(int(a), r) for a, r in pairs])
                first = min([int(a) for a, _ in pairs] + ([first] if first is not None else []))
            self.handle.registerTimer(first)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = timerValues.getCurrentWatermarkInMs()
            every = [(r[0], r[1]) for r in self.waiting.get()] if self.waiting.exists() else []
            due, later = [e for e in every if e[0] <= now], [e for e in every if e[0] > now]
            last = self.last.get()[0] if self.last.exists() else None
            kept, last = kept_of(due, last, horizon)
            self.waiting.clear()
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(min(a for a, _ in later))
            if last is not None:
                if not later and now - last > horizon:
                    self.last.clear()
                else:
                    self.last.update((last,))
                    if not later:
                        self.handle.registerTimer(last + horizon + 1)
            if kept:
                yield pd.DataFrame({"as_json": [r for _, r in kept]})

        def close(self) -> None:
            pass

    return FirstSeen()


def first_seen(stream: DataFrame, key: str, ts: str, horizon_seconds: int, late: str = "10 minutes") -> DataFrame:
    """Rows of a stream, each if no row of its key was kept in the horizon before it. In append mode, once the watermark has passed a row.

    Rows that come later than ``late`` are dropped. State holds what waits for the watermark and a time for each key seen within the horizon.
    Of rows of one key and time the one that comes first as JSON goes first. Rows without a key share one; rows without a time are dropped.
    """
    row = F.to_json(F.struct(*[F.col(c) for c in stream.columns]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    # The names reach the processor as those of a tuple, which begin with no underscore.
    narrow = stream.filter(F.col(ts).isNotNull()).select(F.col(ts).alias("at"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("of_key"), F.unix_millis(ts).alias("at_ms"), row.alias("as_json")).withWatermark("at", late)
    kept = narrow.groupBy("of_key").transformWithStateInPandas(statefulProcessor=_processor(1000 * horizon_seconds), outputStructType="as_json string", outputMode="Append", timeMode="EventTime")
    return kept.select(F.from_json("as_json", stream.schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("r")).select("r.*")


def first_seen_batch(df: DataFrame, key: str, ts: str, horizon_seconds: int) -> DataFrame:
    """The same over a table. Events a horizon and more after the one before them begin a chain of their own, so only chains are gone through in order."""
    row = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    narrow = df.filter(F.col(ts).isNotNull()).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.unix_millis(ts).alias("at"), row.alias("row"))
    in_order, horizon = Window.partitionBy("k").orderBy("at", "row"), 1000 * horizon_seconds
    begins = F.coalesce((F.col("at") - F.lag("at").over(in_order) > horizon).cast("int"), F.lit(1))
    chains = narrow.withColumn("begins", begins).withColumn("chain", F.sum("begins").over(in_order))

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        kept, _ = kept_of(list(zip(rows["at"].tolist(), rows["row"].tolist(), strict=True)), None, horizon)
        return pd.DataFrame({"row": [r for _, r in kept]})

    kept = chains.groupBy("k", "chain").applyInPandas(first, "row string")
    return kept.select(F.from_json("row", df.schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("r")).select("r.*")
