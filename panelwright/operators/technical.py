"""Technical indicators as long tables (code, date, value)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec
from pyspark.sql import functions as F

from .asof import affine_scan

def _by() -> WindowSpec:
    return W.partitionBy("code").orderBy("date")



def _rolling(c: Column, n: int, how: Callable = F.avg) -> Column:
    w = _by().rowsBetween(-n + 1, 0)
    return F.when(F.count(c).over(w) == n, how(c).over(w))


def sma(bars: DataFrame, period: int = 20, of: str = "close") -> DataFrame:
    return bars.select("code", "date", _rolling(F.col(of), period).alias("value"))


def ema(bars: DataFrame, period: int = 20, of: str = "close") -> DataFrame:
    """Seeded with the mean of the first `period` values, one row for each bar; bars without a value have none and are passed over."""
    a = 2 / (period + 1)
    rows = bars.select("code", "date", F.col(of).alias("_x"), F.col(of).isNotNull().alias("_used"))
    w = W.partitionBy("code", "_used").orderBy("date")
    rows = rows.select("*", F.row_number().over(w).alias("_k"), F.avg("_x").over(w.rowsBetween(-period + 1, 0)).alias("_m"))
    step = F.when(F.col("_used") & (F.col("_k") >= period), F.when(F.col("_k") == period, F.col("_m")).otherwise(F.col("_x") * a)).otherwise(0.0)
    seeded = affine_scan(rows, ["code", "_used"], "date", {"_y": step}, 1 - a)
    return seeded.select("code", "date", F.when(F.col("_used") & (F.col("_k") >= period), F.col("_y")).alias("value"))


def wilder(rows: DataFrame, of: str, period: int) -> DataFrame:
    """Wilder's mean with its early weights summing to 1; null until `period` values."""
    a = 1 / period
    used = rows.where(F.col(of).isNotNull()).select("code", "date", F.col(of).alias("_x"), F.row_number().over(_by()).alias("_k"))
    y = affine_scan(used, "code", "date", {"_w": F.col("_x") * a}, 1 - a)
    value = F.when(F.col("_k") >= period, F.col("_w") / (1 - F.pow(F.lit(1 - a), F.col("_k"))))
    return y.select("code", "date", value.alias("value"))


def rsi(bars: DataFrame, period: int = 14) -> DataFrame:
    """Both of Wilder's sums in one scan; their weights cancel in the ratio."""
    change = F.col("close") - F.lag("close").over(_by())
    used = bars.select("code", "date", change.alias("_c")).where("_c is not null").withColumn("_k", F.row_number().over(_by()))
    both = affine_scan(used, "code", "date", {"_up": F.greatest("_c", F.lit(0.0)), "_down": F.greatest(-F.col("_c"), F.lit(0.0))}, 1 - 1 / period)
    value = F.when((F.col("_k") >= period) & (F.col("_up") + F.col("_down") > 0), 100 * F.col("_up") / (F.col("_up") + F.col("_down")))
    return bars.select("code", "date").join(both.select("code", "date", value.alias("value")), ["code", "date"], "left")


def with_strengths(bars: DataFrame, periods: list[int], name: str) -> DataFrame:
    """bars with `name`, an array of rsi() for each of the periods in their order, in one scan of the rows by code."""
    rows = bars.withColumn("_c", F.col("close") - F.lag("close").over(_by())).withColumn("_used", F.col("_c").isNotNull())
    rows = rows.withColumn("_k", F.row_number().over(W.partitionBy("code", "_used").orderBy("date")))
    change = F.coalesce("_c", F.lit(0.0))
    steps = {f"_up{n}": F.greatest(change, F.lit(0.0)) for n in periods} | {f"_down{n}": F.greatest(-change, F.lit(0.0)) for n in periods}
    both = affine_scan(rows, ["code", "_used"], "date", steps, {f"{s}{n}": 1 - 1 / n for s in ("_up", "_down") for n in periods})
    value = lambda n: F.when(F.col("_used") & (F.col("_k") >= n) & (F.col(f"_up{n}") + F.col(f"_down{n}") > 0), 100 * F.col(f"_up{n}") / (F.col(f"_up{n}") + F.col(f"_down{n}")))
    return both.select(*bars.columns, F.array(*(value(n) for n in periods)).alias(name))


def atr(bars: DataFrame, period: int = 14) -> DataFrame:
    pc = F.lag("close").over(_by())
    true_range = F.when(pc.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(pc - F.col("low"))))
    found = wilder(bars.select("code", "date", true_range.alias("r")), "r", period)
    return bars.select("code", "date").join(found, ["code", "date"], "left")


def volume_ma(bars: DataFrame, period: int = 20) -> DataFrame:
    return sma(bars, period, "volume")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, output: str = "macd") -> DataFrame:
    if output not in ("macd", "signal", "hist"):
        raise ValueError(f"unknown output {output}")
    a, b = ema(bars, fast).withColumnRenamed("value", "a"), ema(bars, slow).withColumnRenamed("value", "b")
    line = a.join(b, ["code", "date"]).select("code", "date", (F.col("a") - F.col("b")).alias("m"))
    if output == "macd":
        return line.withColumnRenamed("m", "value")
    own = ema(line.where("m is not null"), signal, "m")
    joined = line.join(own, ["code", "date"], "left")
    return joined.select("code", "date", F.col("value") if output == "signal" else (F.col("m") - F.col("value")).alias("value"))


def bollinger(bars: DataFrame, period: int = 20, width: float = 2.0) -> DataFrame:
    m, s = _rolling(F.col("close"), period), _rolling(F.col("close"), period, F.stddev_pop)
    rows = bars.select("code", "date", "close", m.alias("middle"), s.alias("_s"))
    rows = rows.withColumns({"lower": F.col("middle") - width * F.col("_s"), "upper": F.col("middle") + width * F.col("_s")})
    size = F.col("upper") - F.col("lower")
    return rows.select("code", "date", "lower", "middle", "upper", (100 * size / F.col("middle")).alias("bandwidth"), ((F.col("close") - F.col("lower")) / F.when(size > 0, size)).alias("percent"))


def lagged(factor: DataFrame, n: int = 1) -> DataFrame:
    return factor.select("code", "date", F.lag("value", n).over(_by()).alias("value"))


def bollinger_line(bars: DataFrame, period: int = 20, width: float = 2.0, output: str = "percent") -> DataFrame:
    """One of bollinger()'s columns as a factor."""
    if output not in ("lower", "middle", "upper", "bandwidth", "percent"):
        raise ValueError(f"unknown output {output}")
    return bollinger(bars, period, width).select("code", "date", F.col(output).alias("value"))


FACTORS: dict[str, Callable[..., DataFrame]] = {"sma": sma, "ema": ema, "rsi": rsi, "atr": atr, "volume_ma": volume_ma, "macd": macd, "bollinger": bollinger_line}


def names() -> list[str]:
    return sorted(FACTORS)


def factor(name: str, bars: DataFrame, **parameters) -> DataFrame:
    if name not in FACTORS:
        raise KeyError(f"unknown factor {name}; known: {', '.join(sorted(FACTORS))}")
    return FACTORS[name](bars, **parameters)


def register(name: str, make: Callable[..., DataFrame]) -> None:
    """Adds a factor: a function (bars, **parameters) -> (code, date, value)."""
    if name in ("code", "date", "value"):
        raise ValueError(f"{name} is reserved")
    FACTORS[name] = make
