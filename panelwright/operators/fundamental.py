"""Fundamental factors and cross-sectional statistics by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def inverse(c: Column) -> Column:
    return F.when(c > 0, 1 / c)


def log_positive(c: Column) -> Column:
    return F.when(c > 0, F.ln(c))


def ratio(a: Column, b: Column, positive: bool = True) -> Column:
    return F.when(b > 0 if positive else b != 0, a / b)


#: Factor: its column and whether a higher value is better.
FACTORS: dict[str, tuple[Column, bool]] = {}


def factors() -> dict[str, tuple[Column, bool]]:
    if not FACTORS:
        plain = {"dividend_yield": True, "roe": True, "roa": True, "gross_margin": True, "net_margin": True, "revenue_growth": True, "profit_growth": True, "debt_to_asset": False}
        FACTORS.update({n: (F.col(n), up) for n, up in plain.items()})
        FACTORS.update({"earnings_yield": (inverse(F.col("pe")), True), "book_to_market": (inverse(F.col("pb")), True), "sales_yield": (inverse(F.col("ps")), True), "log_market_cap": (log_positive(F.col("total_mv")), False)})
    return FACTORS


def register(name: str, value: Column, higher_is_better: bool = True) -> None:
    """Adds a user's factor: a column expression over the fundamentals' columns, and nothing else."""
    if not isinstance(value, Column):
        raise TypeError(f"{name} is no column expression")
    if name in ("code", "date", "pub_date", "value"):
        raise ValueError(f"{name} is reserved")
    factors()[name] = (value, higher_is_better)


def value_of(table: DataFrame, name: str) -> DataFrame:
    if name not in factors():
        raise KeyError(f"unknown factor {name}; known: {', '.join(sorted(factors()))}")
    c, _ = factors()[name]
    return table.select("code", F.col("pub_date").alias("date"), c.alias("value"))


def normalise(rows: DataFrame, how: str = "zscore", by: str = "date") -> DataFrame:
    """value by date: zscore, rank, minmax or robust; nulls stay null."""
    w, v = W.partitionBy(by), F.col("value")
    if how == "zscore":
        m, s = F.avg(v).over(w), F.stddev_pop(v).over(w)
        out = (v - m) / F.when(s > 0, s).otherwise(1.0)
    elif how == "rank":
        ties = F.count(v).over(W.partitionBy(by, "value"))
        out = F.when(v.isNotNull(), (F.rank().over(w.orderBy(F.asc_nulls_last("value"))) + (ties - 1) / 2) / F.count(v).over(w))
    elif how == "minmax":
        lo, hi = F.min(v).over(w), F.max(v).over(w)
        out = F.when(v.isNotNull(), F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(0.0))
    elif how == "robust":
        q = lambda p: F.percentile(v, F.lit(p)).over(w)
        iqr = q(0.75) - q(0.25)
        out = (v - q(0.5)) / F.when(iqr > 0, iqr).otherwise(1.0)
    else:
        raise ValueError(f"unknown method {how}")
    return rows.withColumn("value", out)


def winsorise(rows: DataFrame, share: float = 0.01, by: str = "date") -> DataFrame:
    if not 0 < share < 0.5:
        raise ValueError("share must lie between 0 and 0.5")
    w, v = W.partitionBy(by), F.col("value")
    lo, hi = F.percentile(v, F.lit(share)).over(w), F.percentile(v, F.lit(1 - share)).over(w)
    return rows.withColumn("value", F.when(v.isNotNull(), F.least(F.greatest(v, lo), hi)))


def score(table: DataFrame, name: str, how: str = "zscore", share: float = 0.01) -> DataFrame:
    _, up = factors()[name]
    return normalise(winsorise(value_of(table, name), share), how).withColumn("value", F.col("value") * (1 if up else -1))


def composite(scores: list[DataFrame], top: int) -> DataFrame:
    """The mean of scores and the best `top` codes of each date."""
    rows = scores[0]
    for s in scores[1:]:
        rows = rows.unionByName(s)
    mean = rows.groupBy("date", "code").agg(F.avg("value").alias("value"))
    return mean.withColumn("place", F.row_number().over(W.partitionBy("date").orderBy(F.desc_nulls_last("value"), "code"))).where(F.col("place") <= top)
