"""Signals: -1, 0 or 1 by (code, date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec
from pyspark.sql import functions as F

from . import technical
from .custom import Bar

def _by() -> WindowSpec:
    return W.partitionBy("code").orderBy("date")



def ma_rsi(bars: DataFrame, fast: int = 10, slow: int = 30, rsi_period: int = 14, upper: float = 70.0) -> DataFrame:
    """Buy when the fast mean crosses above the slow one below the RSI bound; sell when it crosses below or RSI is above."""
    m = bars.select("code", "date", *(F.when(F.count("close").over(_by().rowsBetween(-n + 1, 0)) == n, F.avg("close").over(_by().rowsBetween(-n + 1, 0))).alias(c) for c, n in (("f", fast), ("s", slow))))
    m = m.join(technical.rsi(bars, rsi_period), ["code", "date"])
    pf, ps = F.lag("f").over(_by()), F.lag("s").over(_by())
    up, down = (F.col("f") > F.col("s")) & (pf < ps), (F.col("f") < F.col("s")) & (pf > ps)
    buy, sell = F.coalesce(up & (F.col("value") < upper), F.lit(False)), F.coalesce(down, F.lit(False)) | F.coalesce(F.col("value") > upper, F.lit(False))
    return m.select("code", "date", F.when(sell, -1).when(buy, 1).otherwise(0).alias("signal"))


def ma_rsi_rule(bar: Bar) -> Column:
    """ma_rsi() for any parameters fast, slow, rsi_period and upper."""
    fast, slow, was_fast, was_slow = (bar.mean(n, back=back) for back in (0, 1) for n in ("fast", "slow"))
    strength, upper = bar.strength("rsi_period"), bar.parameter("upper")
    return bar.signal((fast > slow) & (was_fast < was_slow) & (strength < upper), F.coalesce((fast < slow) & (was_fast > was_slow), F.lit(False)) | F.coalesce(strength > upper, F.lit(False)))


def close_vs_means_rule(bar: Bar) -> Column:
    """close_vs_means() for any parameters fast and slow."""
    return bar.signal(bar.value() > bar.mean("fast"), bar.value() < bar.mean("slow"))


def close_vs_means(bars: DataFrame, fast: int = 10, slow: int = 30, keep: tuple[str, ...] = ()) -> DataFrame:
    """Buy above the fast mean; selling below the slow one overrides.  Columns of bars named in `keep` stay."""
    mean = lambda n: F.when(F.count("close").over(_by().rowsBetween(-n + 1, 0)) == n, F.avg("close").over(_by().rowsBetween(-n + 1, 0)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return bars.select("code", "date", *keep, F.when(yes(F.col("close") < mean(slow)), -1).when(yes(F.col("close") > mean(fast)), 1).otherwise(0).alias("signal"))


def invalid(signals: DataFrame) -> DataFrame:
    """The rows whose signal is not -1, 0 or 1; null counts as 0."""
    return signals.where(~F.coalesce("signal", F.lit(0)).isin(-1, 0, 1))


def skeleton(days: DataFrame, codes: DataFrame) -> DataFrame:
    """(code, date, signal): hold on every day and code; the result itself is their product."""
    return days.select("date").distinct().crossJoin(codes.select("code").distinct()).select("code", "date", F.lit(0).alias("signal"))


def align(signals: DataFrame, days: DataFrame, codes: DataFrame) -> DataFrame:
    """Signals on every (day, code), hold where there is none; others go."""
    return skeleton(days, codes).drop("signal").join(signals.select("code", "date", "signal"), ["code", "date"], "left").select("code", "date", F.coalesce("signal", F.lit(0)).alias("signal"))


def executable(aligned: DataFrame) -> DataFrame:
    """The signal of the trading day before; none on the first day."""
    return aligned.select("code", "date", F.lag("signal").over(_by()).alias("signal")).where("signal is not null")


def counts(signals: DataFrame) -> DataFrame:
    return signals.groupBy("code", "signal").agg(F.count("*").alias("n"))


def combined(rows: DataFrame) -> DataFrame:
    """One signal for each code and date from several rows: any sale overrides any purchase."""
    return rows.groupBy("code", "date").agg(F.when(F.min("signal") < 0, -1).when(F.max("signal") > 0, 1).otherwise(0).alias("signal"))
