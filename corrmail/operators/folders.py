"""Mail folders: types from flags and names, the default selection, buckets by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrmail.functions import lexicon as L
from corrmail.operators.merge import numbered


def folder_type(name: Column, flags: Column | None = None) -> Column:
    """Flags decide before names, and rules in their order; a name need only contain a rule's word."""
    chain, lowered = None, F.lower(F.coalesce(name, F.lit("")))
    if flags is not None:
        by_flag = F.filter(
            F.transform(flags, lambda f: F.coalesce(*[F.when(F.lower(f).contains(mark), F.lit(kind)) for mark, kind in L.FOLDER_FLAGS])),
            lambda x: x.isNotNull(),
        )
        chain = F.get(by_flag, F.lit(0))
    by_name = None
    for kind, words in L.FOLDER_NAMES:
        holds = F.lit(False)
        for w in words:
            holds = holds | lowered.contains(w.lower())
        by_name = F.when(holds, kind) if by_name is None else by_name.when(holds, kind)
    by_name = by_name.otherwise("other")
    return by_name if chain is None else F.coalesce(chain, by_name)


def is_type(name: Column, kind: str, flags: Column | None = None) -> Column:
    return folder_type(name, flags) == kind


def default_scan(folders: DataFrame, include_spam: bool = False, include_archive: bool = False) -> DataFrame:
    skipped = ["drafts", "trash", *["spam"] * (not include_spam), *["archive"] * (not include_archive)]
    return folders.filter(~F.col("folder_type").isin(skipped))


def by_type(folders: DataFrame) -> DataFrame:
    """(folder_type, n_folders, names): all seven types, empty ones included."""
    types = folders.sparkSession.createDataFrame([(t,) for t in L.FOLDER_TYPES], "folder_type string")
    got = folders.groupBy("folder_type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("name")).alias("names"))
    return types.join(got, "folder_type", "left").select("folder_type", F.coalesce("n", F.lit(0)).cast("long").alias("n_folders"), F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def totals(folders: DataFrame) -> DataFrame:
    """(n_folders, n_messages) of the folders that a scan would take."""
    return folders.agg(F.count("*").alias("n_folders"), F.coalesce(F.sum("message_count"), F.lit(0)).cast("long").alias("n_messages"))


def mail_by_date(messages: DataFrame, sent: bool | None = None, account_id: int | None = None) -> DataFrame:
    """Messages of an account, all or only those sent or received, numbered by date and id in ``place``; no date comes first."""
    rows = messages.withColumn("date", F.coalesce("date", F.lit("")))
    if sent is not None:
        rows = rows.filter(F.col("is_sent_by_me") == sent)
    if account_id is not None:
        rows = rows.filter(F.col("account_id") == account_id)
    return numbered(rows, ["date", "id"], "place")
