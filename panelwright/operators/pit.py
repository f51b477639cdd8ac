"""Point-in-time joins: adjustment factors, corporate events, names, members, fundamentals, worklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import parse_date, special_treatment
from .asof import asof, running_product
from .panel import PRICES


def events(raw: DataFrame) -> DataFrame:
    """Raw corporate events with a date (a date, text or a yyyymmdd number) and a standard code; rows without market, category or date go."""
    if dict(raw.dtypes)["date"] != "date":
        raw = raw.withColumn("date", parse_date(F.col("date").cast("string")))
    suffix = F.when(F.col("market") == 0, "SZ").when(F.col("market") == 1, "SH").when(F.col("market") == 2, "BJ")
    code = F.concat(F.substring(F.trim("code"), 1, 6), F.lit("."), suffix)
    return raw.where("market is not null and category is not null and date is not null").withColumn("code", code).where("code is not null")


def ex_rights(raw: DataFrame) -> DataFrame:
    """Category 1, last row of each code and date: dividend, price, bonus and rights for ten shares."""
    zero = lambda c, n: F.coalesce(F.col(c), F.lit(0.0)).alias(n)
    rows = events(raw).where("category = 1").withColumn("_rn", F.row_number().over(W.partitionBy("code", "date").orderBy(F.desc("seq")))).where("_rn = 1")
    return rows.select("code", "date", zero("f1", "dividend"), zero("f2", "price"), zero("f3", "bonus"), zero("f4", "rights"))


def share_capital(raw: DataFrame) -> DataFrame:
    """Category 5, last row of each code and date: float and total shares in ten thousands; total above 0."""
    rows = events(raw).where("category = 5 and f4 > 0").withColumn("_rn", F.row_number().over(W.partitionBy("code", "date").orderBy(F.desc("seq")))).where("_rn = 1")
    return rows.select("code", "date", F.col("f3").alias("float_shares"), F.col("f4").alias("total_shares"))


def cumulative_factors(bars: DataFrame, rights: DataFrame) -> DataFrame:
    """Change points (code, date, cum_factor): 1 at the first bar, then the product of previous close over ex price."""
    closes = bars.where("close > 0").select("code", F.col("date").alias("_d"), "close")
    at = asof(rights, closes, ["code"], "date", "_d", ["close"], strict=True)
    ex = (F.col("close") - F.col("dividend") / 10 + F.col("rights") / 10 * F.col("price")) / (1 + F.col("bonus") / 10 + F.col("rights") / 10)
    steps = at.where("close is not null").withColumn("ex", ex).where("ex > 0").select("code", "date", (F.col("close") / F.col("ex")).alias("ratio"))
    start = bars.groupBy("code").agg(F.min("date").alias("date")).select("code", "date", F.lit(1.0).alias("ratio"))
    w = W.partitionBy("code").orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = start.union(steps).groupBy("code", "date").agg(F.exp(F.sum(F.ln("ratio"))).alias("ratio"))
    return rows.select("code", "date", running_product(F.col("ratio"), w).alias("cum_factor"))


def align_factors(rows: DataFrame, factors: DataFrame, out: str = "cum_factor") -> DataFrame:
    """Each row with the latest factor at or before it, else the code's earliest, else 1."""
    f = factors.select("code", F.col("date").alias("_d"), F.col("cum_factor").alias(out))
    return asof(rows, f, ["code"], "date", "_d", [out], else_first=True).withColumn(out, F.coalesce(out, F.lit(1.0)))


def factor_at(factors: DataFrame, anchor: Column | None = None) -> DataFrame:
    """(code, anchor_factor): the latest factor at or before the anchor, else the first; the last without an anchor."""
    upto = F.max_by("cum_factor", "date") if anchor is None else F.max_by(F.when(F.col("date") <= anchor, F.col("cum_factor")), F.when(F.col("date") <= anchor, F.col("date")))
    return factors.groupBy("code").agg(F.coalesce(upto, F.min_by("cum_factor", "date")).alias("anchor_factor"))


def adjust(bars: DataFrame, factors: DataFrame, mode: str = "backward", anchor: Column | None = None) -> DataFrame:
    """Prices times the factor (over the anchor's, forward); adj_factor is the multiplier; volumes stay."""
    if mode not in ("none", "backward", "forward"):
        raise ValueError(f"unknown mode {mode}")
    rows = align_factors(bars, factors)
    by = F.col("cum_factor")
    if mode == "none":
        return rows.withColumn("adj_factor", F.lit(1.0))
    if mode == "forward":
        rows = rows.join(factor_at(factors, anchor), "code", "left")
        by = by / F.when(F.coalesce("anchor_factor", F.lit(1.0)) != 0, F.coalesce("anchor_factor", F.lit(1.0))).otherwise(1.0)
    priced = [c for c in [*PRICES, "limit_up", "limit_down"] if c in bars.columns]
    rows = rows.withColumn("adj_factor", by)
    return rows.withColumns({c: F.col(c) * F.col("adj_factor") for c in priced}).drop("cum_factor", "anchor_factor")


def shares_at(rows: DataFrame, capital: DataFrame) -> DataFrame:
    """rows with shares as of their date, market caps and turnover."""
    at = asof(rows, capital.withColumnRenamed("date", "_d"), ["code"], "date", "_d", ["float_shares", "total_shares"])
    return at.withColumns({"market_cap": F.col("close") * F.col("total_shares") * 1e4, "float_cap": F.col("close") * F.col("float_shares") * 1e4, "turnover": F.col("volume") / F.when(F.col("float_shares") > 0, F.col("float_shares") * 1e4)})


def names_at(rows: DataFrame, renames: DataFrame, current: DataFrame) -> DataFrame:
    """rows (code, date) with the name then: of the first rename strictly after the date, else the current one."""
    clean = renames.where("change_date between date'1990-01-01' and date'2100-01-01'").groupBy("code", "change_date").agg(F.max_by("name", "seq").alias("name"))
    at = asof(rows, clean, ["code"], "date", "change_date", ["name"], direction="forward", strict=True)
    return at.join(current.select("code", F.col("name").alias("_now")), "code", "left").withColumn("name", F.coalesce("name", "_now")).drop("_now")


def universe_at(dates: DataFrame, master: DataFrame, renames: DataFrame, window: int = 365, drop_st: bool = True) -> DataFrame:
    """(date, code): listed for at least `window` days, not delisted, and without special treatment then."""
    days = dates.select("date").distinct()
    span = days.agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))  # one row
    lo, hi = F.greatest(F.date_add("list_date", window), "_lo"), F.least(F.coalesce(F.date_sub("delist_date", 1), "_hi"), "_hi")
    spans = master.where("list_date is not null").crossJoin(span).select("code", lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    listed = spans.select("code", F.explode(F.sequence("lo", "hi")).alias("date")).join(days, "date", "left_semi").select("date", "code")
    if not drop_st:
        return listed
    return names_at(listed, renames, master).where(~special_treatment(F.col("name"))).select("date", "code")


def members_at(members: DataFrame, date: Column) -> DataFrame:
    """The whole latest snapshot of each index at or before the date."""
    latest = members.where(F.col("snapshot_date") <= date).groupBy("index_code").agg(F.max("snapshot_date").alias("snapshot_date"))
    return members.join(latest, ["index_code", "snapshot_date"])


def stale(last_event: DataFrame, stored: DataFrame, codes: DataFrame, refresh_without: bool = False) -> DataFrame:
    """codes with whether their stored factors are older than the last event, or missing.

    For factors of an external table give the bars as `last_event`: `refresh_without` then says what codes without any need.
    """
    e, s = last_event.groupBy("code").agg(F.max("date").alias("e")), stored.groupBy("code").agg(F.max("date").alias("s"))
    rows = codes.select("code").distinct().join(e, "code", "left").join(s, "code", "left")
    return rows.select("code", (F.col("s").isNull() | F.coalesce(F.col("e") > F.col("s"), F.lit(refresh_without))).alias("refresh"))


def load(bars: DataFrame, factors: DataFrame, start: str, end: str, mode: str = "none") -> DataFrame:
    """Adjusted bars of a closed range; without adjustment they carry cum_factor.  Minute bars (`datetime`) take the factor of their date."""
    inside = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    if "datetime" in bars.columns:
        return adjust(bars.withColumn("date", F.to_date("datetime")).where(inside), factors, mode).drop("date")
    return adjust(bars.where(inside), factors, mode)


def ratio_factors(raw: DataFrame, adjusted: DataFrame) -> DataFrame:
    """(code, date, factor): adjusted over unadjusted close, 1 where the latter is not above 0; days in both tables only."""
    both = raw.select("code", "date", F.col("close").alias("_r")).join(adjusted.select("code", "date", F.col("close").alias("_a")), ["code", "date"])
    return both.select("code", "date", F.when(F.col("_r") > 0, F.col("_a") / F.col("_r")).otherwise(1.0).alias("factor"))


def last_events(rows: DataFrame) -> DataFrame:
    """(code, date): each code's last event, from events()."""
    return rows.groupBy("code").agg(F.max("date").alias("date"))


EVENT_KEY = ["market", "code", "date", "category"]


def new_events(now: DataFrame, before: DataFrame) -> DataFrame:
    """The event keys of a snapshot that the one before lacks, each with the net change in rows of the whole snapshot."""
    net = now.agg(F.count("*").alias("_n")).crossJoin(before.agg(F.count("*").alias("_b"))).select((F.col("_n") - F.col("_b")).alias("net_rows"))
    return now.select(*EVENT_KEY).distinct().join(before.select(*EVENT_KEY), EVENT_KEY, "left_anti").crossJoin(net)


def uncovered(codes: DataFrame, bars: DataFrame, since: str) -> DataFrame:
    """Codes without a bar on or after a date."""
    last = bars.groupBy("code").agg(F.max("date").alias("_d"))
    return codes.select("code").join(last, "code", "left").where(F.col("_d").isNull() | (F.col("_d") < F.lit(since).cast("date"))).select("code")


def rename_history(renames: DataFrame) -> DataFrame:
    """(code, change_date, name, nth): each code's names in order; dates before 1990 or after 2100 go."""
    rows = renames.where((F.year("change_date") >= 1990) & (F.year("change_date") <= 2100))
    return rows.select("code", "change_date", "name", F.row_number().over(W.partitionBy("code").orderBy("change_date", "name")).alias("nth"))
