"""Sync of folders as streaming state: every uid of a folder's epoch once, in any order of arrival.

The state of a folder (split into shares of successive uids, so that a large folder is not one task) is its epoch and
the uids seen, as ranges.  A newer epoch clears the state and says so in a row, so that a sink can drop what it has of
older ones; rows of older epochs are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from corrmail.sources.tables import KeyedTable, ranged

#: Successive uids whose state is kept together.
SHARE = 1 << 20
STORE, PURGE = "store", "purge"
MARKS = "account_id long, folder_id long, listed long, uidvalidity long, last_sync_uid long"


def merged_ranges(ranges: list[tuple[int, int]], uids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(which of the ascending distinct ``uids`` lie in no range, the ranges with them); ranges include both ends."""
    ranges = sorted(ranges)
    first = np.array([a for a, _ in ranges], np.int64)
    last = np.array([b for _, b in ranges], np.int64)
    at = np.searchsorted(first, uids, "right") - 1
    fresh = (at < 0) | (uids > np.where(at >= 0, last[at] if len(last) else 0, 0))
    new = uids[fresh]
    if not len(new):
        return fresh, ranges
    starts = np.concatenate([first, new])
    ends = np.concatenate([last, new])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]  # disjoint, so both ascend
    cut = np.flatnonzero(starts[1:] > ends[:-1] + 1) + 1
    return fresh, list(zip(starts[np.r_[0, cut]].tolist(), ends[np.r_[cut - 1, len(ends) - 1]].tolist()))


class FolderSync(StatefulProcessor):
    """Rows of one share of a folder: those not seen before, with ``action`` store, after a row with action purge for a new epoch."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        longs = lambda *names: StructType([StructField(n, LongType()) for n in names])
        self.epoch = handle.getValueState("epoch", longs("listed", "uidvalidity"))
        self.seen = handle.getMapState("seen", longs("first"), longs("last"))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = self.epoch.get() if self.epoch.exists() else None
        listed, epoch = (int(found[0]), int(found[1])) if found else (0, 0)
        ranges = [(int(k[0]), int(v[0])) for k, v in self.seen.iterator()]
        before = dict(ranges)
        for frame in rows:
            frame = frame.sort_values(["listed", "uidvalidity", "uid"], kind="stable")
            for (at, of), part in frame.groupby(["listed", "uidvalidity"], sort=True):
                at, of = int(at), int(of)
                if of and epoch and of != epoch:
                    if (at, of) < (listed, epoch):
                        continue  # a listing from before the folder began anew
                    ranges = []
                    purge = pd.DataFrame([{"account_id": key[0], "folder_id": key[1], "listed": at, "uidvalidity": of, "action": PURGE}])
                    yield purge.reindex(columns=self.names).astype(object).where(lambda x: x.notna(), None)
                listed, epoch = max(listed, at), of or epoch
                part = part.drop_duplicates("uid")
                fresh, ranges = merged_ranges(ranges, part["uid"].to_numpy(np.int64))
                if fresh.any():
                    yield part[fresh].assign(uidvalidity=epoch, action=STORE)[self.names]
        self.epoch.update((listed, epoch))
        after = dict(ranges)
        for first in before:
            if first not in after:
                self.seen.removeKey((first,))
        for first, last in after.items():
            if before.get(first) != last:
                self.seen.updateValue((first,), (last,))

    def close(self) -> None:
        pass


def synced(stream: DataFrame) -> DataFrame:
    """Rows (account_id, folder_id, uidvalidity, uid, any others) of a stream that were not seen before, with ``action``.

    ``listed`` (0 if the stream has none) says when the source stated the epoch; of one listing the larger epoch is
    newer.  An epoch of 0 is unknown and changes nothing.  Rows without account, folder or uid are left out.
    """
    rows = stream if "listed" in stream.columns else stream.withColumn("listed", F.lit(0).cast("long"))
    rows = rows.filter("account_id is not null and folder_id is not null and uid is not null")
    rows = rows.withColumn("listed", F.coalesce("listed", F.lit(0)).cast("long")).withColumn("uidvalidity", F.coalesce("uidvalidity", F.lit(0)).cast("long"))
    out = StructType(list(rows.schema.fields)).add("action", "string")
    out = StructType([type(f)(f.name, f.dataType, True) for f in out.fields])
    rows = rows.withColumn("_share", F.floor(F.col("uid") / SHARE))
    return rows.groupBy("account_id", "folder_id", "_share").transformWithStateInPandas(FolderSync(out.names), outputStructType=out, outputMode="Append", timeMode="None")


def keep_synced(batch: DataFrame, messages: KeyedTable, marks: KeyedTable) -> None:
    """Store a batch of ``synced`` rows: new messages by key, the newest epoch and largest uid of each folder in ``marks``.

    ``messages`` keeps the rows of older epochs out of sight (see ``current``) until ``purge_old`` removes them.  A
    batch that runs again writes the same rows.
    """
    batch = batch.persist()
    folder = ["account_id", "folder_id"]
    messages.upsert(batch.filter(F.col("action") == STORE))
    newest = F.max_by(F.col("uidvalidity"), F.struct("listed", "uidvalidity"))
    top = batch.groupBy(*folder, "listed", "uidvalidity").agg(F.max(F.when(F.col("action") == STORE, F.col("uid"))).alias("uid"))
    old = marks.matching(top.select(*folder).distinct()).select(*folder, "listed", "uidvalidity", F.col("last_sync_uid").alias("uid"))
    every = top.unionByName(old)
    epoch = every.groupBy(*folder).agg(newest.alias("uidvalidity"), F.max("listed").alias("listed"))
    last = every.groupBy(*folder, "uidvalidity").agg(F.coalesce(F.max("uid"), F.lit(0)).cast("long").alias("last_sync_uid"))
    marks.upsert(epoch.join(last, [*folder, "uidvalidity"]))
    batch.unpersist()


def current(messages: KeyedTable, marks: KeyedTable) -> DataFrame:
    """Stored rows of each folder's current epoch."""
    return messages.read().join(marks.read().select("account_id", "folder_id", "uidvalidity"), ["account_id", "folder_id", "uidvalidity"], "left_semi")


def purge_old(messages: KeyedTable, marks: KeyedTable) -> None:
    """Remove rows of epochs that are over; only buckets that hold such rows are rewritten."""
    now = marks.read().select("account_id", "folder_id", F.col("uidvalidity").alias("_now"))
    stale = messages.read().join(now, ["account_id", "folder_id"]).filter("uidvalidity != _now")
    messages.delete(stale.select(*messages.keys))


def message_table(spark: SparkSession, path: str, schema: str) -> KeyedTable:
    """Messages by account, folder, epoch and uid; new ones touch only the last buckets of their folder."""
    return KeyedTable(spark, path, schema, ("account_id", "folder_id", "uidvalidity", "uid"), ranged("uid", "account_id", "folder_id", "uidvalidity", size=SHARE))


def mark_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, MARKS, ("account_id", "folder_id"))


def run_sync(stream: DataFrame, messages: KeyedTable, marks: KeyedTable, checkpoint: str, partitions: int | None = None) -> StreamingQuery:
    """Take all that has come in, store it, and end; the state outlives the run in ``checkpoint``.

    ``partitions``: into how many parts the state is dealt, those of a shuffle by default; the first run decides.
    """
    conf, key = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    write = synced(stream).writeStream.outputMode("append").foreachBatch(lambda batch, _: keep_synced(batch, messages, marks))
    write = write.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    before = conf.get(key)
    if partitions:
        conf.set(key, partitions)  # a query takes the settings over when it starts
    try:
        return write.start()
    finally:
        conf.set(key, before)
