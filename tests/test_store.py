"""Reading and keeping files: ranges of binary records, snapshots by name, a maintained store, a scan of a folder."""

import datetime as dt
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelwright.operators import panel
from panelwright.sources import scan, store
from panelwright.streaming import upsert

DAY = dt.date(2024, 1, 1)


def read_files(df):
    """How many files the executed plan's scans read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_one_binary_file_is_read_by_several_tasks(spark, tmp_path):
    n = 5000
    a = np.zeros(n, store.DAY)
    days = [DAY + dt.timedelta(i % 300) for i in range(n)]
    a["date"] = [d.year * 10000 + d.month * 100 + d.day for d in days]
    a["close"], a["volume"] = np.arange(n) + 1, 7
    a["date"][[3, 4, 5]] = [20240230, 20241301, 0]  # no dates
    (tmp_path / "sh600000.day").write_bytes(a.tobytes() + b"\x00" * 13)
    (tmp_path / "sz000001.day").write_bytes(a[:10].tobytes())
    (tmp_path / "xx123456.day").write_bytes(a.tobytes())
    (tmp_path / "notes.txt").write_bytes(b"none")
    rows = store.read_binary(spark, str(tmp_path), records=1000)
    assert rows.rdd.getNumPartitions() == 6
    got = sorted((r.code, r.date, r.close, r.volume) for r in rows.collect())
    want = sorted(("600000.SH" if k == n else "000001.SZ", days[i], (i + 1) * 0.01, 7.0) for k in (n, 10) for i in range(k) if i not in (3, 4, 5))
    assert got == want
    assert sorted((r.code, r.date, r.close, r.volume) for r in store.read_binary(spark, str(tmp_path)).collect()) == want
    one = store.read_binary(spark, str(tmp_path), fields=["close"]).where("date >= date'2024-03-01' and date < date'2024-03-03' and close > 1")
    assert one.columns == ["code", "date", "close"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "date#" in plan and not any(f"Filter ({c}" in plan for c in ("date", "isnotnull(date"))
    assert sorted((r.code, r.date, r.close) for r in one.collect()) == [w[:3] for w in want if dt.date(2024, 3, 1) <= w[1] < dt.date(2024, 3, 3) and w[2] > 1]
    empty = tmp_path / "empty"
    empty.mkdir()
    assert store.read_binary(spark, str(empty)).count() == 0


def test_binary_ranges_share_tasks(spark, tmp_path, monkeypatch):
    """Many small ranges and files are few tasks, and every record comes once."""
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(50)]
    rows = [(f"6000{k:02d}.SH", d, *[1.0 + k] * 4, 10.0, float(i)) for k in range(12) for i, d in enumerate(days)]
    bars = spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, amount double, volume double")
    store.write_binary(bars, str(tmp_path))
    got = store.read_binary(spark, str(tmp_path), records=7)
    assert sorted((r.code, r.date, r.close, r.volume) for r in got.collect()) == sorted((r[0], r[1], r[5], r[7]) for r in rows)
    assert got.rdd.getNumPartitions() == 48  # of 96 ranges
    reader = store._FixedWidthReader(StructType.fromDDL(store.BINARY_SCHEMA), {"path": str(tmp_path), "records": "7"})
    monkeypatch.setattr(store, "TASK_RECORDS", 20)
    monkeypatch.setattr(store, "MOST_TASKS", 4)
    sizes = [sum(n for _, _, n in p.ranges) for p in reader.partitions()]
    assert sum(sizes) == 600 and max(sizes) <= 20


def test_only_the_snapshot_needed_is_read(spark, tmp_path):
    for name, code in (("20240102", "A"), ("20240105", "B"), ("20240109", "C"), ("notes", "D")):
        pq.write_table(pa.table({"code": [code]}), tmp_path / f"{name}.parquet")
    at = lambda d: store.index_members_at(spark, str(tmp_path), d)
    assert [(r.code, r.snapshot_date) for r in at("2024-01-08").collect()] == [("B", dt.date(2024, 1, 5))]
    assert [r.code for r in at("2024-01-09").collect()] == ["C"] and at("2024-01-01").count() == 0
    assert read_files(at("2024-01-08")) == 1
    assert read_files(store.index_members(spark, str(tmp_path)).where("snapshot_date = date'2024-01-02'")) == 1
    assert store.index_members(spark, str(tmp_path)).count() == 3


def test_arrival_order_of_files(spark, tmp_path):
    at = lambda h, m: dt.datetime(2024, 1, 2, h, m)
    for k, rows in enumerate(([("A", at(9, 31), 1.0), ("A", at(9, 33), 2.0)], [("A", at(9, 32), 3.0), ("A", at(9, 33), 4.0), ("A", at(9, 33), 5.0)])):
        # The name that sorts first is written last: its time counts.
        where = tmp_path / f"{9 - k}.parquet"
        pq.write_table(pa.table({"code": [r[0] for r in rows], "datetime": pa.array([r[1] for r in rows], pa.timestamp("us", tz="UTC")), "close": [r[2] for r in rows]}), where)
        os.utime(where, (1_700_000_000 + k, 1_700_000_000 + k))
    rows = store.read_arrivals(spark, str(tmp_path))
    last = panel.last_arrived(rows, ["code", "datetime"], "ingest_seq")
    assert sorted((r.datetime.minute, r.close) for r in last.collect()) == [(31, 1.0), (32, 3.0), (33, 5.0)]
    assert [(r.repeats, r.inversions) for r in panel.session_check(rows, "ingest_seq").collect()] == [(2, 1)]


SCHEMA = "code string, date date, close double, ingest_seq int"


def test_store_stays_small_over_many_batches(spark, tmp_path):
    at = str(tmp_path / "store")
    own = upsert.Store(spark, at)
    for k in range(30):
        new = spark.createDataFrame([("A", dt.date(2024, 1 + k % 3, 1), float(k), k)], SCHEMA)
        month = F.date_format("date", "yyyy-MM")
        touched = [f"2024-0{1 + k % 3}"]
        own.put(upsert.upsert(own.read(new.schema, touched), new), touched, month, k)
    files = [f for _, _, names in os.walk(at) for f in names if f.endswith(".parquet")]
    assert len(files) <= 3 + 2 + 2  # three months, the version before and two manifests
    assert own.versions() == [28, 29] and own.vacuum() == 0
    assert sorted((r.date.month, r.close) for r in own.read(new.schema).collect()) == [(1, 27.0), (2, 28.0), (3, 29.0)]
    # What a killed writer leaves behind goes with the next version.
    os.makedirs(f"{at}/data/99-dead/part=2024-01")
    os.makedirs(f"{at}/drafts/99-dead")
    own.vacuum()
    assert not os.path.exists(f"{at}/data/99-dead") and not os.path.exists(f"{at}/drafts")


def test_killed_batch_runs_again(spark, tmp_path, monkeypatch):
    source, at, ck = (str(tmp_path / x) for x in ("in", "store", "ck"))
    rows = [("A", DAY + dt.timedelta(i % 3), float(i), i) for i in range(6)]
    for k in range(3):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    schema = spark.createDataFrame([], SCHEMA).schema
    calls, put = [], upsert.Store.put

    def dies(self, *args, **how):
        put(self, *args, **how)
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed after the version was written")

    monkeypatch.setattr(upsert.Store, "put", dies)
    with pytest.raises(Exception, match="killed"):
        upsert.stream_upsert(spark, source, at, ck, schema)
    monkeypatch.setattr(upsert.Store, "put", put)
    got = upsert.stream_upsert(spark, source, at, ck, schema)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, upsert.upsert(df.limit(0), df).collect()))


def test_second_writer_is_refused(spark, tmp_path):
    source, at = str(tmp_path / "in"), str(tmp_path / "store")
    df = spark.createDataFrame([("A", DAY, 1.0, 1)], SCHEMA)
    df.write.parquet(source)
    upsert.stream_upsert(spark, source, at, str(tmp_path / "one"), df.schema)
    with pytest.raises(RuntimeError, match="release"):
        upsert.stream_upsert(spark, source, at, str(tmp_path / "two"), df.schema)
    upsert.Store(spark, at).release()
    assert upsert.stream_upsert(spark, source, at, str(tmp_path / "two"), df.schema).count() == 1


def test_equal_arrival_numbers_have_one_winner(spark):
    a, b = (spark.createDataFrame([("A", DAY, x, 1)], SCHEMA) for x in (1.0, 2.0))
    assert [r.close for r in upsert.upsert(a, b).collect()] == [2.0]
    both = [sorted(r.close for r in upsert.upsert(a.limit(0), x.union(y)).collect()) for x, y in ((a, b), (b, a))]
    assert both[0] == both[1]


def write(folder, name, **changes):
    base = {
        "date": pa.array([DAY, DAY + dt.timedelta(1), DAY + dt.timedelta(2)]), "code": pa.array([name] * 3), "open": pa.array([1.0, 2.0, 3.0]), "high": pa.array([2.0, 3.0, 4.0]), "low": pa.array([0.5, 1.0, 2.0]),
        "close": pa.array([1.5, 2.5, 3.5]), "volume": pa.array([1, 2, 3]), "amount": pa.array([1.0, 2.0, 3.0]), "is_suspended": pa.array([False] * 3),
    }
    pq.write_table(pa.table({k: v for k, v in (base | changes).items() if v is not None}), folder / f"{name}.parquet")


def test_scan_of_a_folder(spark, tmp_path):
    write(tmp_path, "600000.SH")
    write(tmp_path, "600001.SH", amount=None)
    write(tmp_path, "600002.SH", close=pa.array(["1.5", "x", "3.5"]))
    write(tmp_path, "600003.SH", code=pa.array(["600009.SH"] * 3))
    write(tmp_path, "600004.SH", code=pa.array(["600004.SH", "600005.SH", None]), high=pa.array([2.0, 0.1, None]))
    write(tmp_path, "600006.SH", date=pa.array([DAY, DAY, DAY + dt.timedelta(9)]), volume=pa.array([1, -2, 3]))
    write(tmp_path, "600007.SH", code=pa.array([None] * 3, pa.string()))
    pq.write_table(pq.read_table(tmp_path / "600000.SH.parquet").slice(0, 0), tmp_path / "600008.SH.parquet")
    (tmp_path / "600010.SH.parquet").write_bytes(b"broken")
    calendar = spark.createDataFrame([(DAY + dt.timedelta(i),) for i in range(5)], "date date")
    found = scan.findings(spark, str(tmp_path), calendar)
    got = {(r.file[:6], r.check, r.detail if r.check != "unreadable" else "", r.n) for r in found.collect()}
    assert got == {
        ("600001", "schema", "amount missing", 1), ("600002", "schema", "close is string instead of number", 1), ("600002", "nulls", "close", 1), ("600003", "code", "code 600009.SH", 1),
        ("600004", "code", "several codes", 1), ("600004", "nulls", "high", 1), ("600004", "price logic", "prices", 1), ("600006", "repeats", "date", 1), ("600006", "price logic", "negative", 1),
        ("600006", "continuity", "off the calendar", 1), ("600007", "code", "no code", 1), ("600008", "empty", "no rows", 1), ("600010", "unreadable", "", 1),
    }
    assert [tuple(r) for r in scan.summary(scan.footers(spark, str(tmp_path)), found).collect()] == [(9, 1, 13)]


def test_scan_of_minutes_sees_the_order_in_the_file(spark, tmp_path):
    stamps = [dt.datetime(2024, 1, 2, 9, 31), dt.datetime(2024, 1, 2, 9, 33), dt.datetime(2024, 1, 2, 9, 32), dt.datetime(2024, 1, 2, 12, 0)]
    n = len(stamps)
    pq.write_table(pa.table({"datetime": pa.array(stamps, pa.timestamp("us", tz="UTC")), "code": ["600000.SH"] * n, **{c: [1.0] * n for c in ("open", "high", "low", "close", "volume", "amount")}}), tmp_path / "600000.SH.parquet")
    assert {(r.check, r.detail, r.n) for r in scan.findings(spark, str(tmp_path), minutes=True).collect()} == {("sessions", "outside", 1), ("order", "inversions", 1)}
