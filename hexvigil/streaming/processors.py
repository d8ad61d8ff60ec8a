"""Stateful processors: state kept entry by entry in Spark's state store, looked up by key, never read whole."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def entry_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which entry-wise state needs; the session's own setting returns."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class FirstSeen(StatefulProcessor):
    """Gives the first row of each key and nothing for those that an earlier batch or the initial table holds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A key of the initial table comes here without rows once.
        parts = [p for p in rows if len(p)]
        if parts and not self.seen.exists():
            self.seen.update((True,))
            yield parts[0].iloc[:1]


def first_seen(items: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """The rows of a stream whose key neither came before, however long ago, nor is in ``known``.

    ``known`` is loaded into the state once, before the first batch.  A batch then looks up its own keys only, so what it
    reads follows the batch and not the history.
    """
    initial = None if known is None else known.select(key).distinct().groupBy(key)
    return items.groupBy(key).transformWithStateInPandas(FirstSeen(), items.schema, "Append", "None", initial)


class Category(StatefulProcessor):
    """One category hash: proposers and voters are entries of their own, the rest is one small row."""

    def __init__(self, threshold: int, quorum: int, expire_ms: int | None):
        self.threshold, self.quorum, self.expire_ms = threshold, quorum, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", "category_type string, status string, name string, supporters int, votes int")
        self.proposers = handle.getMapState("proposers", "proposer string", "here boolean")
        self.voters = handle.getMapState("voters", "voter string", "here boolean")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kind, status, name, supporters, votes = self.row.get() if self.row.exists() else (None, "unknown", None, 0, 0)
        batch = pd.concat(list(rows)).sort_values(["ts", "proposer"], kind="stable")
        before = (status, supporters, votes)
        due = self.due.get()[0] if self.due.exists() else None
        for event in batch.itertuples():
            at = int(event.ts.timestamp() * 1000)
            if due is not None and at > due:
                status = "expired"
            if status in ("revealed", "expired"):
                break
            who, news = (event.proposer,), False
            if event.category_type is not None:
                kind = kind or event.category_type
                if news := not self.proposers.containsKey(who):
                    self.proposers.updateValue(who, (True,))
                    supporters += 1
                status = "threshold_met" if supporters >= self.threshold else "pending"
            elif status == "threshold_met" and self.proposers.containsKey(who) and not self.voters.containsKey(who):
                self.voters.updateValue(who, (True,))
                votes, news = votes + 1, True
                if votes >= self.quorum:
                    status, name = "revealed", event.name
            if news and self.expire_ms is not None:
                due = at + self.expire_ms
        if (status, supporters, votes) == before:
            return
        self.row.update((kind, status, name, supporters, votes))
        if status in ("revealed", "expired"):
            self._forget()
        elif due is not None:
            self._rearm(due)
        yield self._state(key, kind, supporters, status, votes, name)

    def _rearm(self, at: int) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        self.due.update((at,))
        self.handle.registerTimer(at)

    def _forget(self) -> None:
        self.proposers.clear()
        self.voters.clear()
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.due.exists() or self.due.get()[0] != expiredTimerInfo.getExpiryTimeInMs():
            return
        kind, _, name, supporters, votes = self.row.get()
        self.due.clear()
        self.proposers.clear()
        self.voters.clear()
        self.row.update((kind, "expired", name, supporters, votes))
        yield self._state(key, kind, supporters, "expired", votes, name)

    @staticmethod
    def _state(key, kind, supporters, status, votes, name) -> pd.DataFrame:
        return pd.DataFrame({
            "category_hash": [key[0]], "category_type": [kind], "supporters": [supporters], "status": [status],
            "reveal_votes": [votes], "revealed_name": [name],
        })


def categories(events: DataFrame, output: str, threshold: int = 3, quorum: int = 2, expire_ms: int | None = None) -> DataFrame:
    """The state of each category hash after every batch that changes it.

    An event looks up or adds one entry, however many proposers a hash has; any text names a proposer.  With
    ``expire_ms`` (the stream then needs a watermark on ``ts``) a hash that gains no proposer or voter for so long of event
    time, and is not revealed, becomes ``expired`` and its entries are dropped: when the watermark passes, or by the event
    that comes later; events don't bring it back.
    """
    mode = "None" if expire_ms is None else "EventTime"
    return events.groupBy("category_hash").transformWithStateInPandas(Category(threshold, quorum, expire_ms), output, "Update", mode)


#: Hash ranges that share a state entry: one call to Python serves all hashes of a range.
BUCKETS = 1 << 12


def live_matches(bundles: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds to every arriving indicator how many rows of other contributions came before it (``known_rows``).

    ``bundles(contribution_id, value_hash, received_at, ...)``: a bundle is one message, so its rows come in one batch;
    within a batch rows count in the order of received_at, then contribution_id; a row without either counts but is not
    judged.  The state is one count a hash, in ``buckets`` entries.  A bucket's rows of one batch meet in one task, which
    holds them once; files per batch bound them.
    """
    schema, columns = bundles.schema.simpleString()[len("struct<") : -1], bundles.columns
    order = ["received_at", "contribution_id"]

    def advance(key, batches, state):
        batch = pd.concat(list(batches)).sort_values(order, kind="stable", ignore_index=True)
        totals = dict(zip(*state.get)) if state.exists else {}
        hashes = [h if isinstance(h, str) else None for h in batch["value_hash"]]
        batch["__h"] = pd.factorize(pd.Series(hashes, dtype=object), use_na_sentinel=False)[0]
        batch["__place"] = batch.groupby("__h").cumcount()
        first = batch.groupby(["__h", *order])["__place"].transform("min")
        found = batch[columns].assign(known_rows=first + [totals.get(h, 0) for h in hashes])
        for h, n in Counter(hashes).items():
            totals[h] = totals.get(h, 0) + n
        state.update((list(totals), list(totals.values())))
        yield found[found["known_rows"] > 0]

    placed = bundles.withColumn("__bucket", F.pmod(F.xxhash64("value_hash"), F.lit(buckets)))
    return placed.groupBy("__bucket").applyInPandasWithState(
        advance, f"{schema},known_rows:bigint", "hashes array<string>, totals array<bigint>", "append", GroupStateTimeout.NoTimeout
    )
