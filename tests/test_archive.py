"""Mail archives, keyed tables and the sync of folders as state."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrmail.sources import archive, mailbox, mime
from corrmail.sources.tables import KeyedTable, clear_analysis, hashed, ranged, set_setting, setting, setting_table
from corrmail.streaming import state

GBK = "您好，欢迎报名夏令营"


def message(k, body, charset="utf-8", when=None):
    when = when or datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(days=k)
    head = f"Message-ID: <m{k}@x>\nDate: {when.strftime('%d %b %Y %H:%M:%S +0000')}\nContent-Type: text/plain; charset={charset}\nContent-Transfer-Encoding: 8bit\n\n"
    return head.encode() + body


def rows_of(df):
    return {(r.file, r.uid): bytes(r.content) for r in df.collect()}


def test_mbox_bytes_are_exact(spark, tmp_path):
    bodies = [GBK.encode("gbk"), b"caf\xe9 \xff\xfe\n", b"a\n>From here\n>>From there\nend\n", b"", b"same\n", b"same\n", b"\n\n", b"x" * 3000 + b"\n"]
    want = [message(k if k != 5 else 4, b, "gbk" if k == 0 else "latin-1") for k, b in enumerate(bodies)]
    raw = b"".join(b"From - Mon Jan  1 00:00:00 2024\n" + archive.quoted(m) + b"\n" + (b"" if m.endswith(b"\n") else b"\n") for m in want)
    want = [m if m.endswith(b"\n") else m + b"\n" for m in want]  # the format ends a message with a line
    (tmp_path / "box").mkdir()
    (tmp_path / "box" / "a.mbox").write_bytes(raw)
    for size in (97, 333, 1 << 20):
        got = archive.read_archive(spark, str(tmp_path / "box"), rangeBytes=size).orderBy("uid").collect()
        assert [bytes(r.content) for r in got] == want
        assert len({r.uid for r in got}) == len(got) and all(raw[r.uid - 1 :].startswith(b"From ") for r in got)
    files = mailbox.read_mbox(spark, str(tmp_path / "box"))
    assert files.select("path").distinct().count() == len(want)  # equal messages stay apart
    parsed = mime.parse_messages(files).filter("message_id = '<m0@x>'").first()
    assert parsed.body_text.strip() == GBK


def test_split_equals_whole_reading():
    rng = random.Random(1)
    for _ in range(300):
        raw = b"From a\n" * (rng.random() < 0.8) + b"".join(rng.choice([b"From b\n", b"x\n", b"\n", b"From", b" c\n", b">From q\n", b"\r\n"]) for _ in range(rng.randrange(0, 30)))
        read = lambda at, n, raw=raw: raw[at : at + min(n, 5)]
        starts = [k for k in range(len(raw)) if raw[k : k + 5] == b"From " and (k == 0 or raw[k - 1 : k] == b"\n")]
        whole = list(archive.split_messages(read, 0, len(raw)))
        assert [a for a, _ in whole] == starts
        cuts = sorted({0, len(raw), *(rng.randrange(0, len(raw) + 1) for _ in range(4))})
        parts = [x for a, b in zip(cuts, cuts[1:]) for x in archive.split_messages(read, a, b)]
        assert parts == whole


def test_written_archive_reads_back_and_filters_choose_ranges(spark, tmp_path):
    path = str(tmp_path / "mail")
    want = [message(k, f"body {k}\nFrom me\n".encode() + b"\x80" * 200 + b"\n") for k in range(100)]
    df = spark.createDataFrame([(k, m) for k, m in enumerate(want)], "k long, content binary").repartitionByRange(4, "k").sortWithinPartitions("k")
    archive.write_archive(df, path, rangeBytes=2000)
    got = archive.read_archive(spark, path)
    assert sorted(rows_of(got).values()) == sorted(want)
    day = datetime(2024, 2, 10, tzinfo=timezone.utc)
    some = got.filter((F.col("sent_at") >= F.lit(day)) & (F.col("sent_at") < F.lit(day + timedelta(days=5))))
    assert sorted(rows_of(some).values()) == sorted(want[40:45])
    assert some.rdd.getNumPartitions() <= 3 < got.rdd.getNumPartitions()
    file, uids = got.first().file, sorted(u for f, u in rows_of(got) if f == got.first().file)
    later = got.filter((F.col("file") == file) & (F.col("uid") > uids[-2]))
    assert [u for _, u in rows_of(later)] == uids[-1:] and later.rdd.getNumPartitions() <= 2
    archive.write_archive(df.filter("k < 3"), path, mode="append")
    assert archive.read_archive(spark, path).count() == 103
    archive.write_archive(df.filter("k < 3"), path, mode="overwrite")
    assert archive.read_archive(spark, path).count() == 3
    assert not [x for x in os.listdir(path) if x.startswith("_staging")]


def test_index_of_foreign_archive(spark, tmp_path):
    raw = b"".join(b"From x\n" + message(k % 50, b"b" * (5000 if k == 60 else 50) + b"\n") + b"\n" for k in range(100))
    (tmp_path / "old.mbox").write_bytes(raw)
    path = str(tmp_path / "old.mbox")
    before = rows_of(archive.read_archive(spark, path))
    assert archive.index_archive(spark, path, 1000).first().ranges > 10
    listed = archive.read_index(path)
    assert [a[1] for a in listed[:-1]] == [b[0] for b in listed[1:]] and (listed[0][0], listed[-1][1]) == (0, len(raw))
    (tmp_path / "old.mbox").write_bytes(raw + b"From x\n" + message(300, b"new\n") + b"\n")  # grown after the list was made
    rows = archive.read_archive(spark, path, rangeBytes=1000)
    assert len(rows_of(rows)) == len(before) + 1
    some = rows.filter(F.col("sent_at") > F.lit(datetime(2024, 2, 18, tzinfo=timezone.utc)))
    assert len(rows_of(some)) == 3 and some.rdd.getNumPartitions() < rows.rdd.getNumPartitions() / 2


def test_reader_opens_only_needed_ranges_and_tries_again(tmp_path):
    path = str(tmp_path / "a.mbox")
    raw = b"".join(b"From x\n" + message(k, b"b" * 500 + b"\n") + b"\n" for k in range(20))
    (tmp_path / "a.mbox").write_bytes(raw)
    from pyspark.sql.datasource import GreaterThan

    reader = archive.ArchiveReader({"path": path, "rangeBytes": "1000"})
    everything = reader.partitions()
    assert list(reader.pushFilters([GreaterThan(("uid",), len(raw) - 1500)]))  # Spark filters again
    left = reader.partitions()
    assert len(left) < len(everything) / 4 and left[0].start >= len(raw) - 1500
    assert len([r for p in left for b in reader.read(p) for r in b.to_pylist()]) == 2

    class Broken:
        failures = 0

        def __init__(self, path):
            self.file = open(path, "rb")

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            Broken.failures += 1
            if Broken.failures % 2:
                raise OSError("reset")
            return self.file.read(n)

        def close(self):
            self.file.close()

    file = archive.RangeFile(path, 3, 0, Broken)
    assert [p for p, _ in archive.split_messages(file.read, 0, len(raw))] == [p for p, _ in archive.split_messages(archive.RangeFile(path, 1, 0).read, 0, len(raw))]
    always = archive.RangeFile(path, 3, 0, lambda p: (_ for _ in ()).throw(OSError("down")))
    with pytest.raises(OSError, match="down"):
        always.read(0, 10)


TABLE = "k long, name string, n long"


def test_keyed_table_equals_dictionary(spark, tmp_path):
    rng = random.Random(2)
    table = KeyedTable(spark, str(tmp_path / "t"), TABLE, ["k"], hashed("k", buckets=4))
    want = {}
    assert table.read().count() == 0
    for step in range(6):
        rows = [(rng.randrange(30) if rng.random() < 0.9 else None, rng.choice(["a", "b", None]), rng.randrange(5)) for _ in range(12)]
        rows = list({r[0]: r for r in rows}.values())
        df = spark.createDataFrame(rows, TABLE)
        kind = step % 4
        if kind == 0:
            table.upsert(df)
            want.update({r[0]: r for r in rows})
        elif kind == 1:
            table.upsert(df.select("k", "name", "n"), only=["name"])
            want.update({r[0]: (r[0], r[1], want[r[0]][2]) if r[0] in want else r for r in rows})
        elif kind == 2:
            table.update(df.select("k"), n=F.col("n") + 1)
            want.update({r[0]: (r[0], want[r[0]][1], want[r[0]][2] + 1) for r in rows if r[0] in want})
        else:
            table.delete(df.select("k"))
            for r in rows:
                want.pop(r[0], None)
        got = sorted(map(tuple, table.read().collect()), key=repr)
        assert got == sorted(want.values(), key=repr)
    table.insert_new(spark.createDataFrame([(next(iter(want)), "changed", 99), (77, "new", 1)], TABLE))
    want[77] = (77, "new", 1)
    assert sorted(map(tuple, table.read().collect()), key=repr) == sorted(want.values(), key=repr)
    table.delete_where(F.lit(True))
    assert table.read().count() == 0


def test_long_table_has_few_folders_with_a_file_each(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), TABLE, ["k"], ranged("k", size=2))
    table.upsert(spark.range(-100, 1500, 1, 8).selectExpr("id as k", "'a' as name", "0L as n"))
    table.update(spark.range(0, 1500, 3).selectExpr("id as k"), n=F.col("n") + 1)
    table.delete(spark.range(0, 1500, 5).selectExpr("id as k"))
    rows = table.read()
    assert sorted((r.k, r.n) for r in rows.collect()) == [(k, int(k >= 0 and k % 3 == 0)) for k in range(-100, 1500) if k < 0 or k % 5]
    files = [r[0] for r in rows.select(F.input_file_name()).distinct().collect()]
    assert len(files) == len({os.path.dirname(f) for f in files}) <= 256


def test_account_of_a_long_table_is_cleared(spark, tmp_path):
    people = KeyedTable(spark, str(tmp_path / "p"), "k long, account_id long", ["k"], ranged("k", size=1))
    links = KeyedTable(spark, str(tmp_path / "l"), "id long, person long", ["id"], ranged("id", size=2))
    people.upsert(spark.range(600).selectExpr("id as k", "id % 5 as account_id"))
    links.upsert(spark.range(1200).selectExpr("id", "id div 2 as person"))
    clear_analysis(spark, 3, {links: (people, "person", "k")})
    assert sorted(r.k for r in people.read().collect()) == [k for k in range(600) if k % 5 != 3]
    assert sorted(r.id for r in links.read().collect()) == [i for i in range(1200) if i // 2 % 5 != 3]
    files = [r[0] for r in links.read().select(F.input_file_name()).distinct().collect()]
    assert len(files) == len({os.path.dirname(f) for f in files}) <= 256


def test_change_reads_and_writes_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, TABLE, ["k"], ranged("k", size=100))
    table.upsert(spark.range(1000).selectExpr("id as k", "'a' as name", "0L as n"))
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = files()
    change = spark.createDataFrame([(950, "b", 1), (1001, "c", 1)], TABLE)
    assert {os.path.dirname(r[0])[-11:] for r in table.touched(change).select(F.input_file_name()).distinct().collect()} == {"t/_bucket=9"}
    plan = table.touched(change)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    table.upsert(change)
    after = files()
    gone = {os.path.dirname(f) for f in before.keys() - after.keys()}
    new = {os.path.dirname(f) for f in after.keys() - before.keys()}
    assert len(gone) == 1 and len(new) == 2
    assert table.read().count() == 1001 and table.read().filter("k = 950").first().name == "b"


def test_ranges_equal_sets():
    rng = np.random.default_rng(5)
    for _ in range(200):
        seen, ranges = set(), []
        for _ in range(6):
            uids = np.unique(rng.integers(0, 60, rng.integers(0, 15)))
            fresh, ranges = state.merged_ranges(ranges, uids)
            assert uids[fresh].tolist() == [u for u in uids.tolist() if u not in seen]
            seen.update(uids.tolist())
            assert sorted(seen) == [u for a, b in ranges for u in range(a, b + 1)]
            assert all(b + 1 < c for (_, b), (c, _) in zip(ranges, ranges[1:]))


STREAM = "account_id long, folder_id long, listed long, uidvalidity long, uid long, body string"


def test_sync_state_over_epochs_batches_and_restarts(spark, tmp_path):
    landing, checkpoint = str(tmp_path / "in"), str(tmp_path / "state")
    messages = state.message_table(spark, str(tmp_path / "messages"), STREAM)
    marks = state.mark_table(spark, str(tmp_path / "marks"))

    def run(rows):
        spark.createDataFrame(rows, STREAM).coalesce(1).write.mode("append").parquet(landing)
        state.run_sync(spark.readStream.schema(STREAM).parquet(landing), messages, marks, checkpoint).awaitTermination()
        now = {(r.account_id, r.folder_id): (r.uidvalidity, r.last_sync_uid) for r in marks.read().collect()}
        return now, sorted((r.folder_id, r.uidvalidity, r.uid, r.body) for r in state.current(messages, marks).collect())

    now, stored = run([(1, 1, 1, 7, u, f"a{u}") for u in (3, 1, 500)] + [(1, 2, 1, 4, 9, "x"), (1, 2, 1, 4, 9, "x")])
    assert now == {(1, 1): (7, 500), (1, 2): (4, 9)} and len(stored) == 4
    # a batch with the end of one epoch and the start of the next; a uid below the mark that was not seen
    now, stored = run([(1, 1, 1, 7, 501, "late"), (1, 1, 2, 8, 1, "n1"), (1, 1, 2, 8, 2, "n2"), (1, 2, 2, 4, 5, "y"), (1, 2, 2, 4, 9, "again")])
    assert now == {(1, 1): (8, 2), (1, 2): (4, 9)}
    assert stored == [(1, 8, 1, "n1"), (1, 8, 2, "n2"), (2, 4, 5, "y"), (2, 4, 9, "x")]
    # the old epoch is over, an unknown one changes nothing, another share of the uids has its own state
    now, stored = run([(1, 1, 1, 7, 502, "old"), (1, 1, 3, 0, 3, "n3"), (1, 1, 3, 8, state.SHARE + 5, "far"), (None, 1, 3, 8, 4, "?")])
    assert now[1, 1] == (8, state.SHARE + 5)
    assert [x for x in stored if x[0] == 1] == [(1, 8, 1, "n1"), (1, 8, 2, "n2"), (1, 8, 3, "n3"), (1, 8, state.SHARE + 5, "far")]
    # an epoch may also go down, as its listing is newer
    now, stored = run([(1, 1, 4, 2, 1, "z")])
    assert now[1, 1] == (2, 1) and [x for x in stored if x[0] == 1] == [(1, 2, 1, "z")]
    state.purge_old(messages, marks)
    assert messages.read().filter("folder_id = 1").count() == 1
    # a batch that runs again leaves the same rows
    again = spark.createDataFrame([(1, 1, 4, 2, 1, "z", "store"), (1, 1, 4, 2, 2, "w", "store")], STREAM + ", action string")
    for _ in range(2):
        state.keep_synced(again, messages, marks)
    assert messages.read().filter("folder_id = 1").count() == 2 and marks.read().filter("folder_id = 1").first().last_sync_uid == 2


def test_settings(spark, tmp_path):
    table = setting_table(spark, str(tmp_path / "settings"))
    assert setting(table, "a", "none") == "none"
    for value in ("1", "2"):
        set_setting(table, "a", value)
    assert (setting(table, "a"), setting(table, "b")) == ("2", "")
