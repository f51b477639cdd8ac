"""Resampling of daily and minute bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNITS = {"month": "month", "quarter": "quarter", "year": "year"}


def _bars(time: str) -> list:
    seen = lambda c: F.when(F.col(c).isNotNull(), F.col(time))
    return [F.min_by("open", seen("open")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", seen("close")).alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount")]


def _carried(bars: DataFrame, time: str) -> list:
    """The last factors of a bin, where the bars have any."""
    return [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(time))).alias(c) for c in ("adj_factor", "cum_factor") if c in bars.columns]


def daily(bars: DataFrame, unit: str) -> DataFrame:
    """Weeks (ending Friday), months, quarters or years; the date is the last real one, factors are its; bins without a close go."""
    bin_ = F.next_day(F.date_sub("date", 1), "FRI") if unit == "week" else F.date_trunc(UNITS[unit], "date").cast("date")
    rows = bars.groupBy("code", bin_.alias("_bin")).agg(F.max("date").alias("date"), *_bars("date"), *_carried(bars, "date"))
    return rows.where("close is not null").drop("_bin")


def minutes(bars: DataFrame, target: int, base: int = 1) -> DataFrame:
    """Groups of target / base consecutive rows within each day, stamped with the last row."""
    if target % base:
        raise ValueError(f"{target} is no multiple of {base}")
    k = target // base
    day = F.to_date("datetime")
    rn = F.row_number().over(W.partitionBy("code", day).orderBy("datetime"))
    rows = bars.withColumn("_day", day).withColumn("_bin", F.floor((rn - 1) / k))
    return rows.groupBy("code", "_day", "_bin").agg(F.max("datetime").alias("datetime"), *_bars("datetime")).drop("_day", "_bin")


def from_base(min1: DataFrame, min5: DataFrame, target: int) -> DataFrame:
    """Multiples of 5 come from five-minute rows for the codes that have any, all else from one-minute rows."""
    if target % 5:
        return minutes(min1, target)
    has = min5.select("code").distinct()
    return minutes(min5, target, 5).unionByName(minutes(min1.join(has, "code", "left_anti"), target))


def sliced(bars: DataFrame, unit: str, start: str, end: str) -> DataFrame:
    """daily() over a closed range; bars stamped outside it go."""
    inside = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return daily(bars.where(inside), unit).where(inside)


def with_daily(minute_rows: DataFrame, days: DataFrame, cols: list[str]) -> DataFrame:
    """Minute rows with the given columns of their code's day; null where the day is absent."""
    return minute_rows.withColumn("date", F.to_date("datetime")).join(days.select("code", "date", *cols), ["code", "date"], "left")
