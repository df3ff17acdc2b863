"""Incremental sync: new rows once each, a new epoch of a folder replaces the old one, bad files go to quarantine."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corrmail.sources.mime import as_messages, parse_messages, quarantine

KEY = ("account_id", "folder_id", "uid")


def new_rows(incoming: DataFrame, state: DataFrame, keys: tuple[str, ...] = ("account_id", "folder_id")) -> DataFrame:
    """Rows of ``incoming`` (keys, uidvalidity, uid, ...) above the last uid that ``state`` has for their folder.

    A folder whose uidvalidity has changed (and was known) starts anew.  Repeated uids are taken once.
    """
    old = state.select(*keys, F.col("uidvalidity").alias("_epoch"), F.col("last_sync_uid").alias("_last"))
    rows = incoming.join(old, list(keys), "left")
    reset = (F.col("_epoch") != F.col("uidvalidity")) & (F.col("_epoch") != 0) & (F.col("uidvalidity") != 0)
    fresh = rows.filter(F.col("_epoch").isNull() | reset | (F.col("uid") > F.col("_last")))
    return fresh.drop("_epoch", "_last").dropDuplicates([*keys, "uid"])


def next_state(rows: DataFrame, state: DataFrame, keys: tuple[str, ...] = ("account_id", "folder_id")) -> DataFrame:
    """The state after ``rows`` (as from new_rows) were stored: the largest uid of each folder's newest epoch.

    Epochs only grow; ``streaming.state`` also takes a source whose epochs fall.
    """
    got = rows.groupBy(*keys).agg(F.max(F.struct("uidvalidity", "uid")).alias("top")).select(*keys, "top.uidvalidity", F.col("top.uid").alias("last_sync_uid"))
    kept = state.select(*keys, "uidvalidity", "last_sync_uid").join(got.select(*keys), list(keys), "left_anti")
    return kept.unionByName(got)


def current_rows(stored: DataFrame, state: DataFrame, keys: tuple[str, ...] = ("account_id", "folder_id")) -> DataFrame:
    """Stored rows of each folder's current epoch: what an epoch change leaves."""
    return stored.join(state.select(*keys, "uidvalidity"), [*keys, "uidvalidity"], "left_semi")


def store_batch(batch: DataFrame, path: str, stream: str, number: int, keys: tuple[str, ...] = KEY) -> None:
    """Store a batch of a stream in a folder of its own: a batch that runs again replaces what it wrote.

    Nothing stored is read, so the cost follows the batch and not the table.
    """
    batch.dropDuplicates(list(keys)).write.mode("overwrite").parquet(f"{path}/stream={stream}/batch={number}")


def stored(spark: SparkSession, path: str, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Rows of all batches; a row that two streams stored (one began anew without its checkpoint) counts once."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return rows.dropDuplicates([k for k in keys if k in rows.columns])


def sync_folder(spark: SparkSession, landing: str, table: str, errors: str, checkpoint: str, owner: str, account_id: int = 1, folder_id: int = 1, done: list[int] | None = None) -> StreamingQuery:
    """Parse message files that have landed since the last run and store them; ends when all are taken.

    Numbers of the batches that were stored go to ``done``.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true").load(landing)
    stream = f"{account_id}-{folder_id}"

    def store(batch: DataFrame, number: int) -> None:
        parsed = parse_messages(batch).persist()  # each file is parsed once
        store_batch(as_messages(parsed, owner, account_id, folder_id), table, stream, number)
        bad = quarantine(parsed).withColumn("account_id", F.lit(account_id).cast("long")).withColumn("folder_id", F.lit(folder_id).cast("long"))
        store_batch(bad, errors, stream, number, ("account_id", "folder_id", "path"))
        parsed.unpersist()
        if done is not None:
            done.append(number)

    return files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


RUNS = "run_id string, account_id long, started_at timestamp, ended_at timestamp, status string, folders long, stored long, errors long"


def _rows_of(spark: SparkSession, path: str, stream: str, batches: list[int]) -> int:
    """Rows of some batches of a stream, from the footers of their files."""
    return spark.read.parquet(*[f"{path}/stream={stream}/batch={n}" for n in batches]).count() if batches else 0


def sync_folders(spark: SparkSession, folders: dict[int, str], base: str, owner: str, account_id: int = 1, cancelled: Callable[[], bool] = lambda: False) -> dict:
    """Sync each folder (id: landing place) in turn, and append a row about the run to ``base``/runs.

    Messages, errors and the state of the streams lie below ``base`` too.  A folder whose sync fails counts as an error
    and does not end the run; ``cancelled`` is asked before each folder.
    """
    started, details, status = datetime.now(), [], "completed"
    for folder, landing in sorted(folders.items()):
        if cancelled():
            status = "cancelled"
            break
        done: list[int] = []
        try:
            sync_folder(spark, landing, f"{base}/messages", f"{base}/errors", f"{base}/state/{account_id}-{folder}", owner, account_id, folder, done).awaitTermination()
            failed = 0
        except StreamingQueryException:
            failed = 1
        got = {t: _rows_of(spark, f"{base}/{t}", f"{account_id}-{folder}", done) for t in ("messages", "errors")}
        details.append({"folder": folder, "stored": got["messages"], "errors": got["errors"] + failed})
    run = {"run_id": uuid.uuid4().hex, "status": status, "folders": len(folders), **{k: sum(d[k] for d in details) for k in ("stored", "errors")}}
    row = (run["run_id"], account_id, started, datetime.now(), status, run["folders"], run["stored"], run["errors"])
    spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(f"{base}/runs")
    return run | {"details": details}
