"""Column expressions: codes and boards, dates, price limits, order prices, fees and fills."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code prefixes of the three exchanges; Beijing is tested before Shenzhen.
SH_PREFIXES = ["600", "601", "603", "605", "688", "689", "900"]
BJ_PREFIXES = ["43", "83", "87", "88", "92"]
SZ_PREFIXES = ["000", "001", "002", "003", "300", "301", "302", "200"]
DATE_FORMATS = ["yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd", "dd-MM-yyyy"]

LOT, TICK = 100, 0.01


def _starts(c: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.startswith(p) for p in prefixes))


def standard_code(code: Column) -> Column:
    """NNNNNN.SH, .SZ or .BJ from suffixed, prefixed or bare codes; others are upper-cased only."""
    u = F.upper(F.trim(code))
    bare = F.when(_starts(u, SH_PREFIXES), "SH").when(_starts(u, BJ_PREFIXES), "BJ").when(_starts(u, SZ_PREFIXES), "SZ").when(_starts(u, ["4", "8"]), "BJ").otherwise("SH")
    return (
        F.when(u.rlike(r"\.(SH|SZ|BJ)$"), u)
        .when(u.rlike("^(SH|SZ|BJ)"), F.concat(F.substring(u, 3, 100), F.lit("."), F.substring(u, 1, 2)))
        .when(u.rlike("^[0-9]+$"), F.concat(u, F.lit("."), bare))
        .otherwise(u)
    )


def tolerant_code(code: Column) -> Column:
    """The same for dirty input: blanks, nan and none give null; short digits are padded to six."""
    t = F.trim(code.cast("string"))
    padded = F.when(t.rlike("^[0-9]{1,5}$"), F.lpad(t, 6, "0")).otherwise(t)
    return F.when((t != "") & ~F.lower(t).isin("nan", "none"), standard_code(padded))


def vendor_code(code: Column, dot: str = "") -> Column:
    """Exchange in lower case before the digits, as vendors spell it."""
    parts = F.split(standard_code(code), r"\.")
    return F.when(F.size(parts) == 2, F.concat(F.lower(parts[1]), F.lit(dot), parts[0])).otherwise(standard_code(code))


def messy_code(raw: Column, suffix: str) -> Column:
    """The first six digits of an exchange's code, standardised; null with fewer."""
    d = F.substring(F.regexp_replace(raw.cast("string"), r"\D", ""), 1, 6)
    s = standard_code(d)
    return F.when(F.length(d) == 6, F.when(s.rlike(r"\.(SH|SZ|BJ)$"), s).otherwise(F.concat(d, F.lit(f".{suffix}"))))


def index_key(code: Column) -> Column:
    """Six digits where exactly six are present, else the code in upper case."""
    d = F.regexp_replace(code, r"\D", "")
    return F.when(F.length(d) == 6, d).otherwise(F.upper(F.trim(code)))


def board(code: Column) -> Column:
    return F.when(code.endswith(".BJ"), "beijing").when(_starts(code, ["688", "689"]), "star").when(_starts(code, ["300", "301"]), "chinext").otherwise("main")


def special_treatment(name: Column) -> Column:
    """Whether a name marks special treatment or delisting."""
    n = F.upper(F.regexp_replace(name, " ", ""))
    return F.coalesce(n.contains("ST") | n.contains("退"), F.lit(False))


def limit_ratio(code: Column, is_st: Column, days_listed: Column | None = None) -> Column:
    """The daily price limit; null while a new listing has none."""
    bj = code.endswith(".BJ")
    usual = F.when(bj, 0.30).when(_starts(code, ["300", "301", "688", "689"]), 0.20).when(is_st, 0.05).otherwise(0.10)
    if days_listed is None:
        return usual
    free = (days_listed >= 1) & (days_listed <= F.when(bj, 1).otherwise(5))
    return F.when(F.coalesce(free, F.lit(False)), F.lit(None).cast("double")).otherwise(usual)


def parse_date(text: Column) -> Column:
    """A date in the first of four formats that fits."""
    shapes = [r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{8}$", r"^\d{4}/\d{1,2}/\d{1,2}$", r"^\d{1,2}-\d{1,2}-\d{4}$"]
    return F.coalesce(*(F.when(text.rlike(s), F.try_to_timestamp(text, F.lit(f)).cast("date")) for s, f in zip(shapes, DATE_FORMATS, strict=True)))


def cents(price: Column) -> Column:
    """Two decimals, halves to even, as the price limits are rounded."""
    return F.rint(price * 100) / 100


def tradable(suspended: Column, price: Column) -> Column:
    return F.coalesce(~suspended & price.isNotNull() & (price > 0), F.lit(False))


def locked(high: Column, low: Column, limit: Column, reach: Column, tick: float = TICK) -> Column:
    """Whether a day is locked at a limit: high and low agree and `reach` touches the limit, within tolerance."""
    tol = lambda ref: F.greatest(F.lit(tick / 2), ref * 0.001)
    return F.coalesce((F.abs(high - low) <= tol(high)) & (F.abs(reach - limit) <= tol(limit)), F.lit(False))


def fill_price(base: Column, side: Column, slip: float = 0.001, min_ticks: int = 1, tick: float = TICK, gap: bool = False, limit_up: Column | None = None, limit_down: Column | None = None) -> Column:
    """Base price with percent slippage, at least some ticks, rounded against the trader and clamped to the limits."""
    if gap:
        price = base
    else:
        move = F.greatest(base * slip, F.lit(min_ticks * tick))
        buy = F.ceil((base + move) / tick - 1e-9) * tick
        sell = F.greatest(F.floor((base - move) / tick + 1e-9) * tick, F.lit(tick))
        price = F.when(side > 0, buy).otherwise(sell)
    if limit_up is not None:
        price = F.when(limit_up.isNull(), price).otherwise(F.least(price, limit_up))
    if limit_down is not None:
        price = F.when(limit_down.isNull(), price).otherwise(F.greatest(price, limit_down))
    return price


def volume_cap(volume: Column, share: float) -> Column:
    """Shares that may trade; null for no cap."""
    return F.when((volume > 0) & F.lit(share > 0), F.floor(volume * share))


def fee(amount: Column, side: Column, commission: float = 0.0003, stamp: float = 0.001, least: float = 5.0) -> Column:
    return F.greatest(amount * commission + F.when(side < 0, amount * stamp).otherwise(0.0), F.lit(least))


def lots(shares: Column) -> Column:
    return (F.floor(shares / LOT) * LOT).cast("long")


def affordable(cash: Column, price: Column, commission: float = 0.0003, least: float = 5.0) -> Column:
    """The largest number of shares, in lots, whose amount and fee fit the cash; none at a price of 0."""
    price = F.nullif(price, F.lit(0.0))
    by_rate = F.floor(cash / (LOT * price * (1 + commission)))
    by_least = F.floor((cash - least) / (LOT * price))
    return (F.greatest(F.lit(0), F.least(by_rate, by_least)) * LOT).cast("long")


def annualised_return(daily: Column, days: int = 252) -> Column:
    return F.pow(1 + daily, days) - 1


def annualised_volatility(daily: Column, days: int = 252) -> Column:
    return daily * F.sqrt(F.lit(float(days)))
