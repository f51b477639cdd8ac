"""Risk flags, performance measures and walk-forward selection.

Equity tables have one row for each scenario and date; all windows are by scenario.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import annualised_return, annualised_volatility

YEAR = 252


def _by(key: list[str]):
    return W.partitionBy(*key).orderBy("date")


def drawdown(equity: DataFrame, key: list[str], limit: float | None = None) -> DataFrame:
    """drawdown from the running peak; halted once it reaches -limit, for good."""
    w = _by(key).rowsBetween(W.unboundedPreceding, W.currentRow)
    peak = F.max("equity").over(w)
    rows = equity.withColumn("drawdown", F.when(peak > 0, F.col("equity") / peak - 1).otherwise(0.0))
    return rows if limit is None else rows.withColumn("halted", F.max(F.col("drawdown") <= -limit + 1e-9).over(w))


def day_stop(equity: DataFrame, key: list[str], limit: float) -> DataFrame:
    change = F.col("equity") / F.nullif(F.lag("equity").over(_by(key)), F.lit(0.0)) - 1
    return equity.withColumn("change", change).withColumn("stopped", F.coalesce(F.col("change") <= -limit + 1e-9, F.lit(False)))


def admit(orders: DataFrame, flags: DataFrame) -> DataFrame:
    """orders (date, side) with whether risk flags (date, halted, stopped) admit them."""
    rows = orders.join(flags.select("date", "halted", "stopped"), "date", "left")
    return rows.withColumn("admitted", ~F.coalesce("halted", F.lit(False)) & ~(F.coalesce("stopped", F.lit(False)) & (F.col("side") > 0))).drop("halted", "stopped")


def clip(orders: DataFrame, held: DataFrame, industries: DataFrame, total: float, single: float, industry: float) -> DataFrame:
    """orders (code, shares, price) cut to what single and industry caps leave, in lots."""
    worth = held.join(industries, "code", "left")
    by_industry = worth.groupBy("industry").agg(F.sum("value").alias("in_industry"))
    rows = orders.join(industries, "code", "left").join(held.select("code", F.col("value").alias("own")), "code", "left").join(by_industry, "industry", "left")
    room = F.lit(total * single) - F.coalesce("own", F.lit(0.0))
    room = F.when(F.col("industry").isNull(), room).otherwise(F.least(room, F.lit(total * industry) - F.coalesce("in_industry", F.lit(0.0))))
    may = F.when(room <= 100 * F.col("price"), 0).otherwise(F.floor(room / (100 * F.col("price"))) * 100)
    return rows.withColumn("allowed", F.least(F.col("shares"), may).cast("long")).select(*orders.columns, "allowed")


def returns(equity: DataFrame, key: list[str]) -> DataFrame:
    """Each row's change over the one before; null at the first row and after an equity of 0."""
    return equity.withColumn("ret", F.col("equity") / F.nullif(F.lag("equity").over(_by(key)), F.lit(0.0)) - 1)


def summary(equity: DataFrame, key: list[str], risk_free: float = 0.0, year: float | str = YEAR) -> DataFrame:
    """total and annual return, sharpe, max_drawdown and calmar of each scenario; its first equity stands for 1.

    `year` is the number of rows a year, or a column of equity that holds it (rounded for the Sharpe ratio).
    """
    year = F.lit(float(year)) if not isinstance(year, str) else F.first(year)
    often = F.rint(year)
    rows = drawdown(returns(equity, key), key)
    agg = rows.groupBy(*key).agg(
        (F.max_by("equity", "date") / F.nullif(F.min_by("equity", "date"), F.lit(0.0))).alias("growth"), F.count("*").alias("n"),
        F.avg("ret").alias("_r"), F.stddev_samp("ret").alias("_s"), F.min("drawdown").alias("max_drawdown"), year.alias("_year"), often.alias("_often"),
    )
    annual = F.when(F.col("growth") <= 0, -1.0).when(F.col("n") > 1, F.pow("growth", F.col("_year") / (F.col("n") - 1)) - 1).otherwise(0.0)
    sharpe = F.when((F.col("n") > 2) & (F.col("_s") >= 1e-12), (F.col("_r") - risk_free / F.col("_often")) / F.col("_s") * F.sqrt("_often")).otherwise(0.0)
    out = agg.select(*key, "n", (F.col("growth") - 1).alias("total_return"), annual.alias("annual_return"), sharpe.alias("sharpe"), "max_drawdown")
    return out.withColumn("calmar", F.when(F.col("max_drawdown") < -1e-12, F.col("annual_return") / F.abs("max_drawdown")).otherwise(0.0))


def trade_statistics(trades: DataFrame, key: list[str]) -> DataFrame:
    """count, win rate, mean win over mean loss, mean holding days; trades without profit count in the total only."""
    win, loss = F.avg(F.when(F.col("pnl") > 0, F.col("pnl"))), F.avg(F.when(F.col("pnl") < 0, F.col("pnl")))
    return trades.groupBy(*key).agg(F.count("*").alias("n_trades"), (F.count_if(F.col("pnl") > 0) / F.count("*")).alias("win_rate"), F.coalesce(win / F.abs(loss), F.lit(0.0)).alias("profit_loss"), F.avg("days").alias("mean_days"))


def against(equity: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row: annual_return, benchmark_return (total), benchmark_annual, alpha and beta.

    The equity's annual return is that of its whole curve.  The benchmark is filled forward onto the equity's
    days and measured over those it reaches, by its own length; beta is over the days on which both have a
    return.  A benchmark of fewer than two rows, given or reached, has zeros, and beta is 0 where it never moves.
    Both series hold one row a day, so their windows have one task.
    """
    whole = summary(equity.select(F.lit(1).alias("id"), "date", "equity"), ["id"]).select("annual_return")
    o = W.orderBy("date")
    given = benchmark.agg(F.count("*").alias("given"))
    rows = equity.select("date", "equity").join(benchmark.select("date", F.col("equity").alias("b")), "date", "left").withColumn("b", F.last("b", ignorenulls=True).over(o.rowsBetween(W.unboundedPreceding, W.currentRow)))
    change = lambda c: F.col(c) / F.nullif(F.lag(c).over(o), F.lit(0.0)) - 1
    r = rows.select("date", "b", change("equity").alias("x"), change("b").alias("y"))
    held = F.col("b").isNotNull()
    total = F.max_by("b", F.when(held, F.col("date"))) / F.nullif(F.min_by("b", F.when(held, F.col("date"))), F.lit(0.0)) - 1
    y = F.when(F.col("x").isNotNull(), F.col("y"))
    own = r.agg(F.count("b").alias("n"), total.alias("total"), F.covar_samp("x", "y").alias("cov"), F.var_samp(y).alias("var"))
    some = (F.col("n") >= 2) & (F.col("given") >= 2)
    zero = lambda c: F.coalesce(F.when(some, c), F.lit(0.0))
    annual = F.when(F.col("total") <= -1, -1.0).otherwise(F.pow(1 + F.col("total"), F.lit(float(YEAR)) / F.greatest(F.lit(1), F.col("n") - 1)) - 1)
    out = own.crossJoin(given).crossJoin(whole)  # one row each
    return out.select("annual_return", zero(F.col("total")).alias("benchmark_return"), zero(annual).alias("benchmark_annual"), zero(F.col("annual_return") - annual).alias("alpha"), zero(F.when(F.col("var") > 0, F.col("cov") / F.col("var"))).alias("beta"))


def bars_per_year(stamps: DataFrame) -> DataFrame:
    """One row: the median yearly count of full enough years over a long span, else the median daily count times 252."""
    span = stamps.agg(F.datediff(F.max("datetime"), F.min("datetime")).alias("span"))
    years = stamps.groupBy(F.year("datetime").alias("y")).agg(F.count("*").alias("n"))
    most = years.agg(F.max("n").alias("most"))
    yearly = years.crossJoin(most).where("n >= 0.5 * most").agg(F.percentile("n", F.lit(0.5)).alias("yearly"))
    daily = stamps.groupBy(F.to_date("datetime")).agg(F.count("*").alias("n")).agg((F.percentile("n", F.lit(0.5)) * YEAR).alias("daily"))
    one = span.crossJoin(yearly).crossJoin(daily)
    return one.select(F.greatest(F.lit(1.0), F.when(F.col("span") >= 365, F.col("yearly")).otherwise(F.col("daily"))).alias("bars_per_year"))


def intraday_summary(equity: DataFrame, key: list[str]) -> DataFrame:
    """summary() of equity by `datetime`, annualised by its own bars a year (a whole number for the Sharpe ratio)."""
    rows = equity.withColumnRenamed("datetime", "date").crossJoin(bars_per_year(equity.select("datetime").distinct()))  # one row
    return summary(rows, key, year="bars_per_year")


def intraday_result(equity: DataFrame, trades: DataFrame, key: list[str]) -> DataFrame:
    """intraday_summary() with trade_statistics() of the run's trades; zeros without a trade."""
    rows = intraday_summary(equity, key).join(trade_statistics(trades, key), key, "left")
    return rows.withColumns({"n_trades": F.coalesce("n_trades", F.lit(0)).cast("long")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("win_rate", "profit_loss", "mean_days")})


def folds(calendar: DataFrame, n: int) -> DataFrame:
    """(fold, train_start, train_end, test_start, test_end): growing training spans, equal tests, the last takes the rest."""
    days = calendar.select("date").distinct().select("date", (F.row_number().over(W.orderBy("date")) - 1).alias("i"), F.count("*").over(W.partitionBy()).alias("total"))
    few = F.raise_error(F.concat("total", F.lit(f" days are too few for {n} folds"))).cast("long")
    chunk = F.when(F.col("total") < 2 * (n + 1), few).otherwise(F.floor(F.col("total") / (n + 1)))
    part = F.least(F.floor(F.col("i") / chunk), F.lit(n)).cast("int")
    spans = days.groupBy(part.alias("part")).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    w = W.orderBy("part")
    return spans.select(F.col("part").alias("fold"), F.min("lo").over(w).alias("train_start"), F.lag("hi").over(w).alias("train_end"), F.col("lo").alias("test_start"), F.col("hi").alias("test_end")).where("fold > 0")


def best_by_fold(train: DataFrame, test: DataFrame, metric: str = "sharpe") -> DataFrame:
    """For each fold the parameters of best training metric (the first of those equal to nine places) with their test metric."""
    w = W.partitionBy("fold").orderBy(F.desc_nulls_last(F.round(metric, 9)), "param_id")
    best = train.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("fold", "param_id", F.col(metric).alias("train_metric"))
    return best.join(test.select("fold", "param_id", F.col(metric).alias("test_metric")), ["fold", "param_id"], "left")


def walk_forward(train: DataFrame, test: DataFrame, metric: str = "sharpe") -> DataFrame:
    """best_by_fold() with the mean test metric of all folds and a warning where a fold's test had no trade.

    A row for each fold: the window over all of them has one task.
    """
    best = best_by_fold(train, test, metric)
    return best.withColumns({"mean_test": F.avg("test_metric").over(W.partitionBy()), "no_trades": F.col("test_metric").isNull()})


def checked(**parameters: float) -> dict[str, float]:
    """Rates, shares and stops, each between 0 and 1, and least fees (`least_...`), 0 or more, as given; others are refused."""
    for name, v in parameters.items():
        if not (v >= 0 if name.startswith("least_") else 0 <= v <= 1):
            raise ValueError(f"{name} = {v} is out of bounds")
    return parameters


def annualised(daily: DataFrame, days: int = YEAR) -> DataFrame:
    """daily (ret, volatility) with both over a year."""
    return daily.withColumns({"annual_return": annualised_return(F.col("ret"), days), "annual_volatility": annualised_volatility(F.col("volatility"), days)})


def realised_equity(trades: DataFrame, days: DataFrame, key: list[str], capital: DataFrame) -> DataFrame:
    """(*key, date, equity): 1 plus the profit of trades closed up to each day over the capital; `capital` has a row for each key.

    Days and keys are all combined: both are small tables (a calendar, parameters and folds).  `days` should
    hold every day on which a trade closes.
    """
    closed = trades.groupBy(*key, F.col("exit_date").alias("date")).agg(F.sum("pnl").alias("_p"))
    grid = capital.join(days, key) if set(key) <= set(days.columns) else capital.crossJoin(days.select("date").distinct())
    rows = grid.join(closed, [*key, "date"], "left")
    w = W.partitionBy(*key).orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.select(*key, "date", (1 + F.sum(F.coalesce("_p", F.lit(0.0))).over(w) / F.col("capital")).alias("equity"))
