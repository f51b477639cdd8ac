"""Golden values on literal rows, and a stream that must equal the batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwright.functions import columns as C
from panelwright.operators import custom, fundamental, limits, master, panel, performance, pit, resample, technical, trading
from panelwright.plans import backtest
from panelwright.sources import store
from panelwright.streaming import upsert

DAY = dt.date(2024, 1, 1)


def days(n):
    return [DAY + dt.timedelta(i) for i in range(n)]


def one(spark, expression, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(expression.alias("x")).first()[0]


@pytest.mark.parametrize("raw,code", [("000001", "000001.SZ"), ("sh600000", "600000.SH"), ("830799", "830799.BJ"), ("920001", "920001.BJ"), ("000001.sz", "000001.SZ"), ("abc", "ABC"), ("510300", "510300.SH")])
def test_codes(spark, raw, code):
    assert one(spark, C.standard_code(F.col("c")), c=raw) == code


def test_dates_and_rounding(spark):
    assert [one(spark, C.parse_date(F.col("d")), d=d) for d in ("2024-01-15", "20240115", "2024/01/15", "15-01-2024", "x")] == [dt.date(2024, 1, 15)] * 4 + [None]
    assert one(spark, C.cents(F.col("p")), p=10.125) == 10.12


def test_adjustment(spark):
    bars = spark.createDataFrame([("A", d, 10.0, 10.0, 10.0, 10.0, 5.0) for d in days(3)], "code string, date date, open double, high double, low double, close double, volume double")
    factors = spark.createDataFrame([("A", days(3)[1], 2.0), ("A", days(3)[2], 4.0)], "code string, date date, cum_factor double")
    close = lambda df: [r.close for r in df.orderBy("date").collect()]
    assert close(pit.adjust(bars, factors)) == [20.0, 20.0, 40.0]
    assert close(pit.adjust(bars, factors, "forward")) == [5.0, 5.0, 10.0]
    assert close(pit.adjust(bars, factors.limit(0))) == [10.0] * 3


def test_cumulative_factor_of_a_bonus_issue(spark):
    bars = spark.createDataFrame([("A", d, c) for d, c in zip(days(3), (10.0, 10.0, 5.0))], "code string, date date, close double")
    rights = spark.createDataFrame([("A", days(3)[2], 0.0, 0.0, 10.0, 0.0)], "code string, date date, dividend double, price double, bonus double, rights double")
    assert [round(r.cum_factor, 9) for r in pit.cumulative_factors(bars, rights).orderBy("date").collect()] == [1.0, 2.0]


def test_limits_skip_the_first_row(spark):
    rows = spark.createDataFrame([("A", d, c, 0.1) for d, c in zip(days(3), (10.0, 11.0, None))], "code string, date date, close double, limit_ratio double")
    assert [(r.limit_up, r.limit_down) for r in limits.limit_prices(rows).orderBy("date").collect()] == [(None, None), (11.0, 9.0), (12.1, 9.9)]


def test_minute_groups_and_weeks(spark):
    t = dt.datetime(2024, 1, 2, 9, 30)
    m = spark.createDataFrame([("A", t + dt.timedelta(minutes=i), float(i), float(i), float(i), float(i), 1.0, 1.0) for i in range(7)], "code string, datetime timestamp, open double, high double, low double, close double, volume double, amount double")
    assert sorted((r.open, r.close, r.volume) for r in resample.minutes(m, 5).collect()) == [(0.0, 4.0, 5.0), (5.0, 6.0, 2.0)]
    with pytest.raises(ValueError):
        resample.minutes(m, 7, 5)


def test_ledger(spark):
    fills = spark.createDataFrame([("A", 1, 1, 200, 10.0), ("A", 2, 1, 200, 20.0), ("A", 3, -1, 100, 30.0), ("A", 4, -1, 300, 10.0), ("A", 5, 1, 100, 7.0)], "code string, seq int, side int, shares int, price double")
    got = [(r.held, round(r.cost, 6), round(r.realised, 6)) for r in trading.ledger(fills).orderBy("seq").collect()]
    assert got == [(200, 2000.0, 0.0), (400, 6000.0, 0.0), (300, 4500.0, 1500.0), (0, 0.0, -1500.0), (100, 700.0, 0.0)]


def test_affordable_equals_a_loop(spark):
    rows = [(1000.0 + 137.7 * i, 1.0 + 0.83 * (i % 37)) for i in range(200)]
    got = spark.createDataFrame(rows, "cash double, price double").select("cash", "price", C.affordable(F.col("cash"), F.col("price")).alias("n")).collect()
    for r in got:
        n = int(r.cash / r.price // 100 * 100)
        while n > 0 and n * r.price + max(n * r.price * 0.0003, 5.0) > r.cash:
            n -= 100
        assert r.n == max(n, 0)


def test_scan_equals_a_loop_and_ignores_order(spark):
    x = [10 + (i * 7919 % 101) / 10 for i in range(300)]
    bars = spark.createDataFrame([("A", DAY + dt.timedelta(i), v) for i, v in enumerate(x)], "code string, date date, close double").orderBy(F.rand(1))
    got = [r.value for r in technical.ema(bars, 12).orderBy("date").collect()]
    y, want = sum(x[:12]) / 12, [None] * 11
    want.append(y)
    for v in x[12:]:
        y += (v - y) * 2 / 13
        want.append(y)
    assert all((a is None and b is None) or abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True))


def test_calendar_shift(spark):
    cal = spark.createDataFrame([(d,) for d in days(10) if d.day not in (3, 4)], "date date")
    d = spark.createDataFrame([(days(10)[2],), (days(10)[9],)], "date date")
    got = lambda n: [r.shifted for r in panel.shift_days(d, cal, n).orderBy("date").collect()]
    assert got(1) == [days(10)[4], None] and got(-1) == [days(10)[1], days(10)[8]]


def test_performance_edges(spark):
    e = spark.createDataFrame([(1, d, 1.0) for d in days(5)], "id int, date date, equity double")
    r = performance.summary(e, ["id"]).first()
    assert (r.sharpe, r.max_drawdown, r.calmar) == (0.0, 0.0, 0.0)


def test_binary_records(spark, tmp_path):
    import numpy as np

    a = np.zeros(2, store.DAY)
    a["date"], a["close"], a["open"], a["high"], a["low"], a["volume"] = [20240102, 20240103], 1234, 1200, 1300, 1100, 500
    (tmp_path / "sz000001.day").write_bytes(a.tobytes())
    rows = store.read_binary(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r.code, r.date, round(r.close, 2), r.volume) for r in rows] == [("000001.SZ", dt.date(2024, 1, 2), 12.34, 500.0), ("000001.SZ", dt.date(2024, 1, 3), 12.34, 500.0)]
    a["volume"] = 500
    for name in ("sh900901.day", "sz200002.day", "sz159915.day", "sh510300.day", "sh000001.day", "bj430047.day"):
        (tmp_path / name).write_bytes(a.tobytes())
    got = {r.code: (round(r.close, 3), r.volume) for r in store.read_binary(spark, str(tmp_path)).where("date = date'2024-01-02'").collect()}
    assert got == {"000001.SZ": (12.34, 500.0), "900901.SH": (1.234, 500.0), "200002.SZ": (12.34, 500.0), "159915.SZ": (1.234, 5.0), "510300.SH": (1.234, 500.0), "000001.SH": (12.34, 500.0), "430047.BJ": (12.34, 500.0)}


def test_binary_minutes(spark, tmp_path):
    import numpy as np

    a = np.zeros(3, store.MINUTE)
    a["date"], a["time"], a["close"], a["volume"] = [(2024 - 2004) * 2048 + 102, (2024 - 2004) * 2048 + 102, 5], [571, 900, 600], [10.5, 11.0, 1.0], [7, 8, 9]
    (tmp_path / "sh600000.lc1").write_bytes(a.tobytes())
    rows = store.read_binary_minutes(spark, str(tmp_path)).orderBy("datetime").collect()
    assert [(r.code, r.datetime, r.close, r.volume) for r in rows] == [("600000.SH", dt.datetime(2024, 1, 2, 9, 31), 10.5, 7.0), ("600000.SH", dt.datetime(2024, 1, 2, 15, 0), 11.0, 8.0)]


def test_files(spark, tmp_path):
    bars = spark.createDataFrame([("A", dt.date(2023, 5, 1), 1.0), ("A", dt.date(2024, 5, 1), 2.0)], "code string, date date, close double")
    store.write_bars(bars, str(tmp_path / "bars"))
    back = store.read_bars(spark, str(tmp_path / "bars")).orderBy("date").collect()
    assert [(r.close, r.year, r.source) for r in back] == [(1.0, 2023, "legacy"), (2.0, 2024, "legacy")]
    raw = spark.createDataFrame([("A", "2024-01-02", "1.5"), ("A", "n/a", "2"), ("A", "2024-01-03", "x")], "code string, date string, cum_factor string")
    assert store.write_factors(raw, str(tmp_path / "f")) and spark.read.parquet(str(tmp_path / "f")).count() == 1
    assert not store.write_factors(raw.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    members = spark.createDataFrame([("600000.SH",)], "code string")
    for name in ("20240102", "20240103", "notes"):
        members.coalesce(1).write.parquet(str(tmp_path / "part"), mode="overwrite")
        (tmp_path / "members").mkdir(exist_ok=True)
        next((tmp_path / "part").glob("part-*.parquet")).rename(tmp_path / "members" / f"{name}.parquet")
    assert sorted(r.snapshot_date for r in store.index_members(spark, str(tmp_path / "members")).collect()) == [dt.date(2024, 1, 2), dt.date(2024, 1, 3)]
    store.write_equity(spark.createDataFrame([(DAY, 1.5)], "date date, equity double"), str(tmp_path / "equity"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "equity")).collect()] == [("2024-01-01", "1.5")]
    assert panel.schema_findings(bars, {"code": "string", "close": "string", "open": "double"}) == [("close", "double instead of string"), ("open", "missing")]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("A", days(3)[i % 3], float(i), i) for i in range(9)]
    schema = "code string, date date, close double, ingest_seq int"
    for k in range(3):
        spark.createDataFrame(rows[3 * k : 3 * k + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = spark.createDataFrame(rows, schema)
    run = lambda: sorted(map(tuple, upsert.stream_upsert(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), df.schema).collect()))
    want = lambda d: sorted(map(tuple, upsert.upsert(d.limit(0), d).collect()))
    assert run() == want(df)
    # A restart keeps what is stored, and a file of one month leaves the other month's files alone.
    more = spark.createDataFrame([("B", dt.date(2024, 2, 1), 1.0, 0), ("A", days(3)[0], 99.0, 50)], schema)
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == want(df.union(more)) and run() == want(df.union(more))


def test_suspensions(spark):
    cal = spark.createDataFrame([(d,) for d in days(6)], "date date")
    row = lambda i, close, volume, flag: ("A", days(6)[i], close, close, close, close, volume, 1.0, flag)
    bars = spark.createDataFrame([row(0, 1.0, 5.0, False), row(1, 1.0, 0.0, False), row(2, 1.0, None, False), row(3, 1.0, 5.0, True), row(5, 1.0, 0.0, False)], "code string, date date, open double, high double, low double, close double, volume double, amount double, is_suspended boolean")
    sure = spark.createDataFrame([("A", days(6)[i]) for i in (0, 1, 2, 4)], "code string, date date")
    got = [(r.source, r.is_suspended) for r in limits.label_gaps(bars, cal, sure).orderBy("date").collect()]
    assert got == [("feed", False), ("feed", True), ("feed", True), ("feed", True), ("feed:suspend", True), ("feed", False)]
    codes = spark.createDataFrame([("A",), ("B",)], "code string")
    told = lambda a, b: {r.code: r.suspended for r in limits.range_suspended(codes, sure, cal, a, b).collect()}
    assert told("2024-01-01", "2024-01-03") == {"A": True, "B": False} and told("2024-01-01", "2024-01-04") == {"A": False, "B": False}
    assert told("2030-01-01", "2030-01-04") == {"A": False, "B": False}
    with pytest.raises(ValueError):
        panel.trading_range(cal, "2024-01-04", "2024-01-01")


def test_cleaning_twice_changes_nothing(spark):
    rows = [("A", days(3)[0], "10", "9", "8", "-1", "5", "x", None, 1), ("A", days(3)[0], "10", "12", "8", "11", "5", "7", "true", 2), ("A", days(3)[1], "10", "12", "8", "11", "-5", "7", "false", 1), ("B", days(3)[1], "3", "1", "2", None, "1", "1", None, 1)]
    names = ["open", "high", "low", "close", "volume", "amount", "is_suspended"]
    once = panel.clean(spark.createDataFrame(rows, "code string, date date, " + ", ".join(f"{c} string" for c in names) + ", ingest_seq int"))
    assert sorted(map(repr, panel.clean(once).collect())) == sorted(map(repr, once.collect())) and once.count() == 3


def test_splits_last(spark):
    held = spark.createDataFrame([("A", d, n) for d, n in zip(days(5), (100, 100, 100, 250, 250))], "code string, date date, shares long")
    ratios = spark.createDataFrame([("A", days(5)[1], 2.0), ("A", days(5)[4], 1.5), ("A", days(5)[2], 1.0)], "code string, date date, ratio double")
    assert [r.shares for r in trading.apply_splits(held, ratios).orderBy("date").collect()] == [100, 200, 200, 350, 525]
    paid = trading.dividends(held, spark.createDataFrame([("A", days(5)[2], 5.0)], "code string, date date, dividend double"))
    account = spark.createDataFrame([(d, 10.0, 0.0, 10.0, 1) for d in days(4)], "date date, cash double, value double, total double, n_positions int")
    assert [(r.cash, r.total, r.realised) for r in trading.credited(account, paid).orderBy("date").collect()] == [(10.0, 10.0, 0.0)] * 2 + [(60.0, 60.0, 50.0)] * 2


def test_order_status(spark):
    row = lambda side, shares, sellable, volume, cash=1e6: ("A", DAY, side, shares, cash, sellable, 10.0, 11.0, 9.0, volume, False, 12.0, 8.0)
    rows = [row(-1, 50, 50, 900.0), row(-1, 500, 50, 0.0), row(-1, 120, 300, 0.0), row(-1, 50, 300, 0.0), row(1, 500, 0, 900.0), row(1, 500, 0, 2500.0), row(1, 100, 0, 0.0), row(1, 300, 0, 0.0, 500.0), row(-1, 100, 0, 0.0)]
    schema = "code string, date date, side int, shares long, cash double, sellable long, open double, high double, low double, volume double, is_suspended boolean, limit_up double, limit_down double"
    orders = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", id int")
    got = [(r.status, r.filled) for r in trading.match(orders, least_amount=1500.0).orderBy("id").collect()]
    assert got == [("filled", 50), ("partial", 50), ("ignored", 0), ("ignored", 0), ("ignored", 0), ("partial", 200), ("ignored", 0), ("ignored", 0), ("failed", 0)]


def test_master_tables(spark):
    rows = spark.createDataFrame([("A", "N1", None), ("A", "N2", "2020-01-02"), ("A", "N3", "2019-01-02"), ("B", "N4", None)], "code string, name string, delist_date string")
    parsed = rows.withColumn("delist_date", F.to_date("delist_date"))
    assert {(r.code, r.name) for r in master.merge(parsed, parsed.where("delist_date is not null")).collect()} == {("A", "N2"), ("B", "N4")}
    lists = [spark.createDataFrame(r, "code string, position int") for r in ([("x", 1), ("y", 2)], [("z", 1), ("x", 2)])]
    assert [(r.code, r.place) for r in master.code_list(lists).orderBy("place").collect()] == [("x", 1), ("y", 2), ("z", 3)]


def test_user_factors(spark):
    bars = spark.createDataFrame([(c, d, float(i)) for c in "AB" for i, d in enumerate(days(3))], "code string, date date, close double")

    def odd(part):
        if part["code"].iloc[0] == "B":
            raise ValueError("no")
        return part["close"] * 2

    got = custom.by_code(bars, odd).collect()
    assert sorted(r.value for r in got if r.code == "A") == [0.0, 2.0, 4.0] and [(r.value, r.error) for r in got if r.code == "B"] == [(None, "ValueError: no")]
    assert all(r.error.startswith("ValueError: 1 values for 2") for r in custom.by_date(bars, lambda part: [1.0]).collect())
    fundamental.register("cheap", 1 / F.col("pe"), True)
    try:
        assert fundamental.value_of(spark.createDataFrame([("A", DAY, 4.0)], "code string, pub_date date, pe double"), "cheap").first().value == 0.25
    finally:
        fundamental.FACTORS.pop("cheap")
    with pytest.raises(TypeError):
        fundamental.register("bad", lambda t: t)
    with pytest.raises(ValueError):
        technical.register("code", technical.sma)
    assert "bollinger" in technical.names() and technical.factor("bollinger", bars, period=2, output="middle").where("value is not null").count() == 4
    s = custom.strategy("ma_rsi")
    # The registered space spans fast 3 to 20, slow up to 120, strength periods 6 to 30 and bounds 65 and 80.
    wide = [(f, w, r, u) for f in (3, 10, 20) for w in (25, 60, 120) for r in (6, 14, 30) for u in (65.0, 80.0) if w >= f + 5]
    assert [tuple(r) for r in s.settings(spark).orderBy("param_id").select("param_id", "fast", "slow", "rsi_period", "upper").collect()] == [(i, *x) for i, x in enumerate(wide)]
    with pytest.raises(KeyError):
        s.run(bars, speed=1)
    with pytest.raises(KeyError):
        custom.strategy("none")


def test_parameter_bounds():
    assert performance.checked(commission=0.0, stop=1.0, least_fee=5.0) == {"commission": 0.0, "stop": 1.0, "least_fee": 5.0}
    for bad in ({"commission": -0.1}, {"stop": 1.2}, {"least_fee": -1.0}, {"stop": float("nan")}):
        with pytest.raises(ValueError):
            performance.checked(**bad)


def test_signals_lost_without_a_bar_on_the_next_day(spark):
    # A's sale of day 2 is due on day 3, on which only B has a bar; it is lost, and the next sale counts.
    rows = spark.createDataFrame([("A", days(8)[i], 10.0 + i, 10.0, False, g) for i, g in ((0, 1), (1, 0), (2, -1), (4, 0), (5, -1), (6, 0))] + [("B", d, 1.0, 1.0, False, 0) for d in days(8)], "code string, date date, open double, close double, is_suspended boolean, signal int")
    got = [(r.date.day, r.event) for r in trading.next_day_positions(rows, rows).where("code = 'A' and event is not null").orderBy("date").collect()]
    assert got == [(2, "entry"), (7, "exit")]
    trades = backtest.sleeves(rows.drop("signal"), rows.select("code", "date", "signal")).collect()
    assert [(r.code, r.entry_date.day, r.exit_date.day) for r in trades] == [("A", 2, 7)]


def test_unknown_factor():
    with pytest.raises(KeyError):
        technical.factor("nothing", None)


def test_benchmark_that_begins_late(spark):
    dates = [dt.date(2024, 1, d) for d in (1, 2, 3, 4, 5, 8)]
    equity = [1.0]
    for r in (0.05, -0.02, 0.10, -0.03, 0.04):
        equity.append(equity[-1] * (1 + r))
    own = spark.createDataFrame(list(zip(dates, equity, strict=True)), "date date, equity double")
    index = spark.createDataFrame(list(zip(dates[2:], [100.0, 110.0, 110 * 0.97, 110 * 0.97 * 1.04], strict=True)), "date date, equity double")
    got = performance.against(own, index).first()
    annual, total = equity[-1] ** (252 / 5) - 1, 1.10 * 0.97 * 1.04 - 1
    assert got.beta == pytest.approx(1.0) and got.benchmark_return == pytest.approx(total)
    assert got.annual_return == pytest.approx(annual) and got.benchmark_annual == pytest.approx((1 + total) ** (252 / 3) - 1) and got.alpha == pytest.approx(annual - got.benchmark_annual)
    # One day of overlap, one row, none: zeros.  A benchmark that never moves has no beta.
    for few in (index.limit(0), index.limit(1), index.where("date = '2024-01-08'").union(index.limit(1).withColumn("date", F.lit("2024-03-01").cast("date")))):
        assert tuple(performance.against(own, few).first())[1:] == (0, 0, 0, 0)
    flat = performance.against(own, index.withColumn("equity", F.lit(5.0))).first()
    assert (flat.beta, flat.benchmark_return) == (0.0, 0.0) and flat.alpha == pytest.approx(annual)


def test_nothing_divides_by_zero(spark):
    curve = spark.createDataFrame([(1, d, e) for d, e in zip(days(4), (1.0, 0.0, 0.0, 2.0), strict=True)], "id int, date date, equity double")
    assert [r.ret for r in performance.returns(curve, ["id"]).orderBy("date").collect()] == [None, -1.0, None, None]
    assert [r.stopped for r in performance.day_stop(curve, ["id"], 0.5).orderBy("date").collect()] == [False, True, False, False]
    assert performance.summary(curve.where("date > '2024-01-01'"), ["id"]).first().total_return is None
    assert one(spark, C.affordable(F.col("c"), F.col("p")), c=1000.0, p=0.0) == 0 and one(spark, trading.order_size(F.col("v"), 0.5, F.col("p")), v=1000.0, p=0.0) == 0


def test_matrix_keeps_the_last_arrival_on_the_calendar(spark):
    d = days(4)
    rows = [("A", d[0], 9.0, 1), ("A", d[0], 5.0, 2), ("B", d[2], 1.0, 3), ("C", d[2], 2.0, 5), ("C", d[2], None, 6), ("A", d[3], 4.0, 1)]
    bars = spark.createDataFrame(rows, "code string, date date, close double, ingest_seq int")
    calendar = spark.createDataFrame([(x,) for x in (d[0], d[1], d[2], DAY - dt.timedelta(9))], "date date")
    places = panel.code_places(bars, 2)
    assert sorted(map(tuple, places.collect())) == [("A", 0, 0), ("B", 0, 1), ("C", 1, 0)]
    blocks = panel.matrix(bars, places, calendar=calendar)
    assert sorted((r.date, r.block, r["values"]) for r in blocks.collect()) == [(d[0], 0, [5.0, None]), (d[0], 1, [None]), (d[1], 0, [None, None]), (d[1], 1, [None]), (d[2], 0, [None, 1.0]), (d[2], 1, [None])]
    assert {(r.code, r.date): r.value for r in panel.unpacked(blocks, places).where("value is not null").collect()} == {("A", d[0]): 5.0, ("B", d[2]): 1.0}
    assert sorted(map(tuple, panel.wide(bars, ["A", "C"]).collect())) == [(d[0], 5.0, None), (d[2], None, None), (d[3], 4.0, None)]
    assert [tuple(r) for r in panel.wide(bars, ["A"], calendar=calendar).orderBy("date").collect()] == [(d[0], 5.0), (d[1], None), (d[2], None)]


def test_folds_over_ordered_steps(spark):
    import random

    rng = random.Random(1)
    fills, held, cost, want = [], 0, 0.0, []
    for i in range(700):
        sell = held > 0 and rng.random() < 0.5
        shares, price = (rng.choice([held, max(1, held // 3)]) if sell else rng.randrange(1, 900)), rng.uniform(1, 50)
        prior = cost
        cost = prior * (1 - shares / held) if sell else prior + shares * price
        gain = shares * price - prior * shares / held if sell else 0.0
        held += -shares if sell else shares
        want.append((i, held, cost if held else 0.0, gain))
        fills.append(("A", i, -1 if sell else 1, shares, price, "kept"))
    df = spark.createDataFrame(fills, "code string, seq int, side int, shares long, price double, note string").repartition(3)
    got = trading.ledger(df)
    assert got.columns == [*df.columns, "held", "cost", "realised", "average"]
    for r, w in zip(got.orderBy("seq").collect(), want, strict=True):
        assert (r.seq, r.held, r.note) == (w[0], w[1], "kept") and r.cost == pytest.approx(w[2], rel=1e-11, abs=1e-7) and r.realised == pytest.approx(w[3], rel=1e-11, abs=1e-7)
    ratios = spark.createDataFrame([("A", days(9)[i], 1.5) for i in (2, 5)], "code string, date date, ratio double")
    own = spark.createDataFrame([("A", x, s) for x, s in zip(days(9), (0, 101, 101, 101, 0, 0, 7, 7, 7), strict=True)], "code string, date date, shares long")
    split = trading.apply_splits(own, ratios)
    assert [r.shares for r in split.orderBy("date").collect()] == [0, 101, 151, 151, 50, 75, 82, 82, 82]
    for df in (got, split):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def random_bars(spark, n=90, codes=("A", "B", "C|D")):
    import random

    rng, rows = random.Random(4), []
    for c in codes:
        price = 20.0
        for i in range(n):
            price = round(max(1.0, price * (1 + rng.uniform(-0.06, 0.06))), 2) if i % 11 else price
            if rng.random() < 0.9:
                rows.append((c, days(n)[i], price, round(price * 1.02, 2), round(price * 0.98, 2), price, 1000.0, rng.random() < 0.03))
    return spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double, is_suspended boolean")


OWN = custom.Strategy(None, {"enter": 10, "leave": 5, "n": 6}, {"enter": [5, 12], "leave": [4], "n": [3, 6]}, rule=lambda bar: bar.signal((bar.value() > bar.highest("enter", back=1)) & (bar.strength("n") < 95), bar.value() < bar.mean("leave")))


def test_windows_whose_length_is_a_column(spark):
    from panelwright.operators import signals

    bars = random_bars(spark)
    for name, setting in (("ma_rsi", {"fast": 3, "slow": 9, "rsi_period": 5, "upper": 75.0}), ("close_vs_means", {"fast": 4, "slow": 11})):
        made = custom.strategy(name)
        want = {tuple(r) for r in made.run(bars, **setting).where("signal <> 0").select("code", "date", "signal").collect()}
        other = [{"param_id": 1} | setting, {"param_id": 2} | setting | {"fast": 2}]
        got = made.run_all(bars, other)
        assert want and {tuple(r) for r in got.where("param_id = 1").select("code", "date", "signal").collect()} == want
    # Means of one price are equal whatever their lengths, so nothing crosses.
    flat = bars.withColumn("close", F.lit(0.1) + F.lit(0.2))
    assert custom.Strategy(None, {}, rule=lambda bar: bar.signal(bar.mean(3) > bar.mean(7), bar.mean(3) < bar.mean(7))).run_all(flat, [{"param_id": 0}]).isEmpty()
    gaps = spark.createDataFrame([("A", d, x) for d, x in zip(days(6), (1.0, 2.0, None, 4.0, 5.0, 6.0), strict=True)], "code string, date date, close double")
    bar = custom.Bar([{"n": 2}, {"n": 3}])
    cells = [bar.mean("n"), bar.mean("n", back=1), bar.highest("n", of="close"), bar.value(back=1)]
    rows = bar.prepared(gaps).withColumn("_p", F.struct(F.lit(2).alias("n"))).select("date", *(c.alias(f"c{i}") for i, c in enumerate(cells))).orderBy("date").collect()
    assert [tuple(r)[1:] for r in rows] == [(None, None, None, None), (1.5, None, 2.0, 1.0), (None, 1.5, None, 2.0), (None, None, None, None), (4.5, None, 5.0, 4.0), (5.5, 4.5, 6.0, 5.0)]
    assert signals.skeleton(gaps, gaps).count() == 6


def test_strategies_with_and_without_a_rule_are_swept_alike(spark):
    bars = random_bars(spark)
    made = custom.strategy("close_vs_means")
    plain = custom.Strategy(made.signals, made.defaults, made.space, made.valid)
    params = made.settings(spark)
    a, b = (sorted(map(tuple, backtest.sweep(bars, params, s).select("param_id", "n_trades", F.round("pnl", 6), F.round("sharpe", 9)).collect())) for s in (made, plain))
    assert a == b and any(r[1] for r in a)
    with pytest.raises(ValueError):
        plain.run_all(bars, [{"param_id": i, "fast": 1, "slow": 2} for i in range(custom.MOST_BRANCHES + 1)])
    with pytest.raises(ValueError):
        backtest.sweep(bars, spark.range(backtest.MOST_PARAMETERS + 1).select(F.col("id").alias("param_id"), F.lit(1).alias("fast"), F.lit(2).alias("slow")), made)


@pytest.mark.parametrize("strategy", [OWN, "close_vs_means"])
def test_each_span_is_a_run_of_its_own(spark, strategy):
    bars, n = random_bars(spark), 2
    params = (OWN if strategy is OWN else custom.strategy(strategy)).settings(spark)
    calendar = panel.calendar_of(bars)
    cols = ["param_id", "n_trades", *(F.round(c, 9) for c in ("pnl", "total_return", "sharpe", "max_drawdown"))]
    spans = backtest.span_scores(bars, params, calendar, n, strategy)
    got = {(k, f): sorted(map(tuple, spans.where((F.col("kind") == k) & (F.col("fold") == f)).select(*cols).collect())) for k in ("train", "test") for f in (1, 2)}
    for f in performance.folds(calendar, n).collect():
        for k in ("train", "test"):
            alone = backtest.sweep(bars.where(F.col("date").between(f[f"{k}_start"], f[f"{k}_end"])), params, strategy)
            assert got[k, f.fold] == sorted(map(tuple, alone.select(*cols).collect()))
    assert any(r[1] for rows in got.values() for r in rows)
    best = backtest.walk_forward(bars, params, calendar, n, strategy=strategy).collect()
    assert [r.fold for r in sorted(best)] == [1, 2]


def test_macd_of_repeated_dates(spark):
    """Bars that repeat a code and date: each has one mean, and lines meet by code and date once, as in SQL, however often that is done."""
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), 10.0 + i % 5) for i in range(60)]
    rows += [("A", dt.date(2024, 2, 20), 12.0)] * 2  # three bars
    bars = spark.createDataFrame(rows, "code string, date date, close double")
    assert technical.factor("ema", bars, period=20).count() == 62
    assert technical.factor("macd", bars).count() == 59 + 9
    assert [technical.factor("macd", bars, output=o).count() for o in ("signal", "hist")] == [59 + 81] * 2


def test_strengths_in_one_scan(spark):
    """Several periods in one scan equal rsi() of each, also with missing closes, over several blocks of rows."""
    rows = [(c, dt.date(2024, 1, 1) + dt.timedelta(days=i), None if i % 17 == 3 else 10.0 + (i * 7 + k) % 11) for k, c in enumerate("AB") for i in range(200)]
    bars = spark.createDataFrame(rows, "code string, date date, close double")
    got = {(r.code, r.date): r.s for r in technical.with_strengths(bars, [6, 14], "s").collect()}
    for at, n in enumerate((6, 14)):
        for r in technical.rsi(bars, n).collect():
            mine = got[r.code, r.date][at]
            assert (mine is None) == (r.value is None) and (mine is None or abs(mine - r.value) < 1e-9)


def test_sweep_moves_bars_once(spark):
    """The bars of a sweep are shuffled by code only, strengths and fills included."""
    bars = spark.createDataFrame([("A", dt.date(2024, 1, 1), *[1.0] * 4, 1.0, False)], "code string, date date, open double, high double, low double, close double, volume double, is_suspended boolean")
    trades = backtest.sweep_trades(bars, custom.strategy("ma_rsi").settings(spark))
    plan = trades._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(code" in line for line in plan.splitlines()) == 1
    assert "SortMergeJoin" not in plan


def test_continuity_counts_rows(spark):
    """Rows that repeat a day count each time off the calendar; a code of one repeated day has a gap of -1, as in SQL."""
    bars = spark.createDataFrame([("A", DAY), ("A", DAY), ("B", DAY), ("B", DAY + dt.timedelta(1)), ("B", DAY + dt.timedelta(1))], "code string, date date")
    calendar = spark.createDataFrame([(DAY,), (DAY + dt.timedelta(2),)], "date date")
    assert sorted((r.code, r.off_calendar, r.longest_gap) for r in panel.continuity(bars, calendar).collect()) == [("A", 0, -1), ("B", 2, 0)]


def test_upsert_keeps_ties(spark):
    rows = spark.createDataFrame([("A", DAY, 1.0, 1), ("A", DAY, 2.0, 2), ("A", DAY, 3.0, 2), ("B", DAY, 4.0, 1), ("B", DAY, 4.0, 1)], "code string, date date, close double, ingest_seq int")
    got = upsert.upsert(rows.where("ingest_seq = 1"), rows.where("ingest_seq = 2"), ties=True)
    assert sorted(r.close for r in got.collect()) == [2.0, 3.0, 4.0, 4.0]
