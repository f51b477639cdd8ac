"""Orders, positions, trades and ledgers as table operators.

Shared cash is replaced by sleeves: every code trades its own fixed budget, so that codes are
independent and windows by code suffice; the portfolio is the sum of its sleeves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import affordable, fee, fill_price, locked, lots, tradable, volume_cap
from .asof import scanned
from .panel import shift_days

def _by() -> WindowSpec:
    return W.partitionBy("code").orderBy("date")


def _upto() -> WindowSpec:
    return _by().rowsBetween(W.unboundedPreceding, W.currentRow)



def match(orders: DataFrame, pct: float = 0.1, least_amount: float = 0.0) -> DataFrame:
    """orders (side, shares, cash, sellable and the day's bar) with status, filled, price and fee.

    A sale of all that is sellable may clear an odd lot and is free of the least amount.
    """
    price = fill_price(F.col("open"), F.col("side"))
    can = tradable(F.col("is_suspended"), F.col("open"))
    shut = F.when(F.col("side") > 0, locked(F.col("high"), F.col("low"), F.col("limit_up"), F.col("high"))).otherwise(locked(F.col("high"), F.col("low"), F.col("limit_down"), F.col("low")))
    cap = volume_cap(F.col("volume"), pct)
    wanted = F.when(F.col("side") > 0, F.col("shares")).otherwise(F.least("shares", "sellable"))
    capped = F.when(cap.isNull(), wanted).otherwise(F.least(wanted, cap))
    buy = lots(F.least(capped, affordable(F.col("cash"), price)))
    sell = F.when((capped >= F.col("sellable")), F.col("sellable")).otherwise(lots(capped))
    rows = orders.withColumns({"price": price, "filled": F.when(F.col("side") > 0, buy).otherwise(sell).cast("long")}).drop("_cap")
    none, closing = F.coalesce(F.col("filled") <= 0, F.lit(True)), (F.col("side") < 0) & (F.col("filled") >= F.col("sellable"))
    status = (
        F.when(~can | shut | ((F.col("side") < 0) & (F.col("sellable") <= 0)), "failed")
        .when(none | ((F.col("filled") * F.col("price") < least_amount) & ~closing), "ignored")
        .when(F.col("filled") < F.col("shares"), "partial")
        .otherwise("filled")
    )
    done = rows.withColumn("status", status).withColumn("filled", F.when(F.col("status").isin("partial", "filled"), F.col("filled")).otherwise(F.lit(0)).cast("long"))
    return done.withColumn("fee", F.when(F.col("filled") > 0, fee(F.col("filled") * F.col("price"), F.col("side"))).otherwise(0.0))


def positions(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """(code, date, event, held): the last fillable signal so far decides; an entry is a buy while flat, an exit a sale while held."""
    ok = tradable(F.col("is_suspended"), F.col("open"))
    day = signals.join(bars.select("code", "date", "open", "close", "is_suspended"), ["code", "date"], "left")
    want = F.when(F.coalesce(ok, F.lit(False)) & (F.col("signal") != 0), F.col("signal"))
    state = F.coalesce(F.last(want, ignorenulls=True).over(_upto()), F.lit(-1)) == 1
    rows = day.withColumn("held", state).withColumn("_was", F.coalesce(F.lag("held").over(_by()), F.lit(False)))
    event = F.when(F.col("held") & ~F.col("_was"), "entry").when(~F.col("held") & F.col("_was"), "exit")
    return rows.withColumn("event", event).drop("_was")


def next_day_positions(rows: DataFrame, days: DataFrame, key: tuple[str, ...] = ("code",)) -> DataFrame:
    """rows (bars with a signal) with held and event when each signal is filled on the next of the market's days.

    A signal is lost when its code has no bar on that day, which the code's own next row tells: no grid of days and codes.
    """
    w = W.partitionBy(*key).orderBy("date")
    before = days.select("date").distinct().select("date", F.lag("date").over(W.orderBy("date")).alias("_day"))
    last = rows.withColumns({"_sig": F.lag("signal").over(w), "_last": F.lag("date").over(w)}).join(before, "date", "left")
    due = F.when(F.col("_last") == F.col("_day"), F.col("_sig"))
    want = F.when(tradable(F.col("is_suspended"), F.col("open")) & (due != 0), due)
    state = F.coalesce(F.last(want, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit(-1)) == 1
    held = last.withColumn("held", state).withColumn("_was", F.coalesce(F.lag("held").over(w), F.lit(False)))
    event = F.when(F.col("held") & ~F.col("_was"), "entry").when(~F.col("held") & F.col("_was"), "exit")
    return held.withColumn("event", event).drop("_sig", "_last", "_day", "_was")


def sleeve_trades(held: DataFrame, budget: float, key: tuple[str, ...] = ("code",)) -> DataFrame:
    """Round trips: each entry sized in lots from the budget, closed by the next exit; open ones are left out."""
    w = W.partitionBy(*key).orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    events = held.where("event is not null").withColumn("episode", F.count_if(F.col("event") == "entry").over(w))
    side = F.when(F.col("event") == "entry", 1).otherwise(-1)
    priced = events.withColumn("price", fill_price(F.col("open"), side))
    trip = priced.groupBy(*key, "episode").agg(*(F.max(F.when(F.col("event") == e, F.col(c))).alias(f"{e}_{c}") for e in ("entry", "exit") for c in ("date", "price")))
    sized = trip.where("entry_date is not null and exit_date is not null").withColumn("shares", affordable(F.lit(budget), F.col("entry_price"))).where("shares > 0")
    spent = F.col("shares") * F.col("entry_price") + fee(F.col("shares") * F.col("entry_price"), F.lit(1))
    got = F.col("shares") * F.col("exit_price") - fee(F.col("shares") * F.col("exit_price"), F.lit(-1))
    return sized.withColumns({"cost": spent, "pnl": got - spent, "days": F.datediff("exit_date", "entry_date")}).withColumn("pnl_pct", F.col("pnl") / F.col("cost"))


CHUNK = 256


def ledger(fills: DataFrame, fee_rate: float = 0.0) -> DataFrame:
    """fills (code, seq, side, shares, price) with held, average cost and realised profit after each.

    The cost follows C = m * C + b with m = 1 - sold / held (0 when all is sold) and b = what a purchase costs.
    A code's fills go in chunks: what a chunk does to any cost is one such step, so the cost with which each
    chunk begins is folded from the chunks before it, and within a chunk from fill to fill.
    """
    w = W.partitionBy("code").orderBy("seq")
    rows = fills.select("code", "seq", F.struct(*(fills[f"`{c}`"] for c in fills.columns)).alias("_fill"), "side", "shares", "price", F.sum(F.col("side") * F.col("shares")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("held"), (F.row_number().over(w) - 1).alias("_n"))
    before = F.col("held") - F.col("side") * F.col("shares")
    keep = F.when(F.col("side") > 0, 1.0).otherwise(F.coalesce(1 - F.col("shares") / F.nullif(before, F.lit(0)), F.lit(0.0)))
    spent = F.when(F.col("side") > 0, F.col("shares") * F.col("price") * (1 + fee_rate)).otherwise(0.0)
    steps = rows.select("code", F.floor(F.col("_n") / CHUNK).alias("chunk"), F.struct("_n", "held", before.alias("before"), keep.cast("double").alias("m"), spent.cast("double").alias("b"), "_fill").alias("x"))
    chunks = steps.groupBy("code", "chunk").agg(F.array_sort(F.collect_list("x"), lambda p, q: (p["_n"] - q["_n"]).cast("int")).alias("xs"))
    whole = F.aggregate("xs", F.struct(F.lit(1.0).alias("m"), F.lit(0.0).alias("b")), lambda s, x: F.struct((s["m"] * x["m"]).alias("m"), (s["b"] * x["m"] + x["b"]).alias("b")))
    earlier = F.collect_list("whole").over(W.partitionBy("code").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    begun = chunks.withColumn("whole", whole).withColumn("earlier", earlier)
    start = F.aggregate("earlier", F.lit(0.0), lambda c, x: c * x["m"] + x["b"])
    costs = begun.select("code", "xs", start.alias("start")).withColumn("costs", scanned(F.col("xs"), F.col("start"), lambda c, x: c * x["m"] + x["b"], "double"))
    each = costs.select("xs", "costs", F.concat(F.array("start"), "costs").alias("prior"))
    cells = each.select(F.explode(F.arrays_zip("xs", "costs", F.slice("prior", F.lit(1), F.size("costs")).alias("prior"))).alias("z")).select("z.xs.*", F.col("z.costs").alias("_c"), F.col("z.prior").alias("_prior"))
    f = lambda c: F.col("_fill").getField(c)
    cost = F.when(F.col("held") > 0, F.col("_c")).otherwise(0.0)
    realised = F.when(f("side") < 0, f("shares") * f("price") - F.coalesce(F.col("_prior") * f("shares") / F.nullif(F.col("before"), F.lit(0)), F.lit(0.0))).otherwise(0.0)
    return cells.select(*(f(c).alias(c) for c in fills.columns), "held", cost.alias("cost"), realised.alias("realised"), F.when(F.col("held") > 0, cost / F.col("held")).alias("average"))


def sellable(fills: DataFrame) -> DataFrame:
    """(code, date, held, frozen, sellable, frozen_cash) at the end of each day with fills: shares bought and proceeds of sales stay frozen that day."""
    day = fills.groupBy("code", "date").agg(F.sum(F.col("side") * F.col("shares")).alias("net"), F.sum(F.when(F.col("side") > 0, F.col("shares")).otherwise(0)).alias("bought"), F.sum(F.when(F.col("side") < 0, F.col("shares") * F.col("price")).otherwise(0.0)).alias("frozen_cash"))
    held = F.sum("net").over(_upto())
    return day.select("code", "date", held.alias("held"), F.least("bought", held).alias("frozen"), (held - F.least("bought", held)).alias("sellable"), "frozen_cash")


def holdings(fills: DataFrame, days: DataFrame) -> DataFrame:
    """(code, date, shares) on every given (code, date): 0 before the first fill."""
    net = fills.groupBy("code", "date").agg(F.sum(F.col("side") * F.col("shares")).alias("net"))
    rows = days.select("code", "date").join(net, ["code", "date"], "left")
    return rows.select("code", "date", F.coalesce(F.sum("net").over(_upto()), F.lit(0)).alias("shares"))


def market_value(held: DataFrame, bars: DataFrame) -> DataFrame:
    """Holdings at the last valid close."""
    rows = held.join(bars.select("code", "date", "close"), ["code", "date"], "left")
    close = F.last(F.when(F.col("close") > 0, F.col("close")), ignorenulls=True).over(_upto())
    return rows.select("code", "date", "shares", (F.col("shares") * F.coalesce(close, F.lit(0.0))).alias("value"))


def account(fills: DataFrame, values: DataFrame, capital: float) -> DataFrame:
    """(date, cash, value, total, n_positions) by day; the daily table is small and its running sum has one task."""
    flow = fills.groupBy("date").agg(F.sum(-F.col("side") * F.col("shares") * F.col("price")).alias("flow"))
    day = values.groupBy("date").agg(F.sum("value").alias("value"), F.count_if(F.col("shares") > 0).alias("n_positions")).join(flow, "date", "left")
    cash = F.lit(capital) + F.sum(F.coalesce("flow", F.lit(0.0))).over(W.orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = day.withColumn("cash", cash)
    return rows.select("date", "cash", "value", (F.col("cash") + F.col("value")).alias("total"), "n_positions")


def split_ratio(rows: DataFrame) -> DataFrame:
    """cum_factor over the previous row's where that exceeds 1.001, else 1."""
    prev = F.lag("cum_factor").over(_by())
    r = F.col("cum_factor") / F.when(prev > 0, prev)
    return rows.withColumn("ratio", F.when(r > 1.001, r).otherwise(1.0))


def apply_splits(held: DataFrame, ratios: DataFrame) -> DataFrame:
    """Holdings by (code, date) after splits: from a split on they stay multiplied by its ratio, whole shares only; the cost stays.

    A day's split comes before its fills.  Only a code's days with a fill or a split are walked through, in
    their order, since each split rounds what the one before it left.
    """
    w = _by()
    net = F.col("shares") - F.coalesce(F.lag("shares").over(w), F.lit(0))
    rows = held.select("code", "date", net.cast("long").alias("net")).join(ratios.select("code", "date", "ratio"), ["code", "date"], "left")
    steps = rows.where("net <> 0 or ratio > 1").select("code", "date", "net", F.coalesce("ratio", F.lit(1.0)).alias("ratio"))

    each = steps.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("date", "net", "ratio"))).alias("xs"))
    left = scanned(F.col("xs"), F.lit(0), lambda shares, x: F.floor(shares * F.greatest(x["ratio"], F.lit(1.0)) + 1e-9).cast("bigint") + x["net"], "bigint")
    after = each.select("code", F.explode(F.arrays_zip(F.col("xs.date").alias("date"), left.alias("shares"))).alias("z")).select("code", "z.date", "z.shares")
    days = held.select("code", "date").join(after, ["code", "date"], "left")
    return days.select("code", "date", F.coalesce(F.last("shares", ignorenulls=True).over(_upto()), F.lit(0)).cast("long").alias("shares"))


def credited(days: DataFrame, credits: DataFrame) -> DataFrame:
    """account() with dividends paid: cash, total and `realised` grow by all credits (date, credit) up to the day; costs stay."""
    paid = credits.groupBy("date").agg(F.sum("credit").alias("_c"))
    rows = days.join(paid, "date", "left")
    sum_ = F.sum(F.coalesce("_c", F.lit(0.0))).over(W.orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("_s", sum_)
    return rows.select("date", (F.col("cash") + F.col("_s")).alias("cash"), "value", (F.col("total") + F.col("_s")).alias("total"), "n_positions", F.col("_s").alias("realised"))


def dividends(held: DataFrame, paid: DataFrame) -> DataFrame:
    """(code, date, credit): shares times the dividend of ten shares over ten."""
    return held.join(paid.select("code", "date", "dividend"), ["code", "date"]).select("code", "date", (F.col("shares") * F.col("dividend") / 10).alias("credit"))


def unadjustable(bars: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Codes whose rows lack cum_factor although adj_factor differs from 1."""
    return bars.groupBy("code").agg(F.count_if(F.col("cum_factor").isNull() & (F.abs(F.col("adj_factor") - 1) > tolerance)).alias("n")).where("n > 0")


def force_close(held: DataFrame, bars: DataFrame, days: DataFrame) -> DataFrame:
    """(code, date, shares, price, fee): exits on the first trading day after a code's last bar, at its last close, for codes still held."""
    end = bars.groupBy("code").agg(F.max("date").alias("last"), F.max_by("close", "date").alias("price"))
    still = held.groupBy("code").agg(F.max_by("shares", "date").alias("shares")).where("shares > 0")
    moved = shift_days(end.select(F.col("last").alias("date")).distinct(), days, 1).where("shifted is not null")
    nxt = end.join(moved.select(F.col("date").alias("last"), F.col("shifted").alias("date")), "last")
    return nxt.join(still, "code").select("code", "date", "shares", "price", fee(F.col("shares") * F.col("price"), F.lit(-1)).alias("fee"))


def order_size(value: Column, weight: float, price: Column) -> Column:
    """Shares, in lots, for a share of a portfolio's value; 0 below one lot."""
    return F.coalesce(lots(value * weight / F.nullif(price, F.lit(0.0))), F.lit(0).cast("long"))


def intents(held: DataFrame) -> DataFrame:
    """(date, code, side, place): the orders of each day, sells before buys, from positions()."""
    side = F.when(F.col("event") == "exit", -1).when(F.col("event") == "entry", 1)
    rows = held.where("event is not null").select("date", "code", side.alias("side"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("date").orderBy("side", "code")))


def equity_curve(days: DataFrame, capital: float) -> DataFrame:
    """(date, equity) from account(): the total over the capital."""
    return days.select("date", (F.col("total") / capital).alias("equity"))
