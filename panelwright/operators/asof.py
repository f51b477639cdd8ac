"""As-of joins by union and window, and linear recurrences by a two-level scan: no theta join, no UDF."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], time: str, right_time: str, cols: list[str], direction: str = "backward", strict: bool = False, else_first: bool = False) -> DataFrame:
    """left with `cols` of the last row of right at or before its time (the first at or after it, going forward).

    `right` should hold one row for each key and time.  Rows of left keep their number; without a match the
    columns are null, or with `else_first` those of the key's first row of right.  A column may itself be
    null in the matched row.
    """
    forward = direction == "forward"
    packed = F.struct(*(F.col(c).alias(c) for c in cols))
    l = left.select("*", F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType).alias("_p"))
    r = right.select(*by, F.col(right_time).alias("_t"), F.lit(2 if strict else 0).alias("_side"), packed.alias("_p"))
    order = [F.desc("_t") if forward else F.asc("_t"), F.asc("_side")]
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    match = F.last("_p", ignorenulls=True).over(w)
    if else_first:
        match = F.coalesce(match, F.first("_p", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_m", match)
    return both.where("_side = 1").select(*left.columns, *(F.col(f"_m.{c}").alias(c) for c in cols))


def affine_scan(df: DataFrame, by: str | list[str], order: str, steps: dict[str, Column], k: float | dict[str, float]) -> DataFrame:
    """For each column y of `steps` and its b: y = k * previous y + b along each key, from the first row; b is never null and 0 < k < 1.

    In blocks of 64 rows y is k^i * sum(b_j * k^-j); what a block inherits is a short sum over the ends of
    the blocks before it, back to where k^(64 n) vanishes.  All of it are windows by key, so that rows move once.
    k may be a number for each column.
    """
    block, keys = 64, [by] if isinstance(by, str) else by
    factors = k if isinstance(k, dict) else dict.fromkeys(steps, k)
    numbered = df.withColumns({f"_b_{c}": b for c, b in steps.items()}).withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1)
    numbered = numbered.withColumn("_block", F.floor(F.col("_n") / block)).withColumn("_i", F.col("_n") % block)
    inside = W.partitionBy(*keys, "_block").orderBy("_i")
    partial = numbered.withColumns({f"_y_{c}": F.pow(F.lit(q), F.col("_i")) * F.sum(F.col(f"_b_{c}") * F.pow(F.lit(q), -F.col("_i"))).over(inside) for c, q in factors.items()})
    reach = max(1, math.ceil(math.log(1e-18) / (block * math.log(max(factors.values())))))
    before = W.partitionBy(*keys).orderBy("_block").rangeBetween(-reach, -1)
    end = F.when(F.col("_i") == block - 1, F.struct(*(F.col(f"_y_{c}").alias(c) for c in steps)))
    carried = partial.withColumn("_ends", F.collect_list(end).over(before))
    carried_of = lambda c, whole: F.aggregate("_ends", F.lit(0.0), lambda a, x: a * whole + x[c])
    carry = {c: carried_of(c, q**block) for c, q in factors.items()}
    return carried.select(*df.columns, *((F.col(f"_y_{c}") + carry[c] * F.pow(F.lit(q), F.col("_i") + 1)).alias(c) for c, q in factors.items()))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scanned(steps: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The array of states (of the SQL type `kind`) after each of an array's steps, from `start`, by step(state, step).

    An aggregate that appends copies what it has so far, so it goes through parts of the square root's length.
    """
    cut = lambda a: _let(F.ceil(F.sqrt(F.size(a))).cast("int"), lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / c).cast("int")), lambda k: F.slice(a, k * c + 1, c)))
    empty = lambda of: F.array().cast(f"array<{of}>").alias("out")
    one = lambda s, x: _let(step(s["now"], x), lambda y: F.struct(y.alias("now"), F.array_append(s["out"], y).alias("out")))
    part = lambda s, p: _let(F.aggregate(p, F.struct(s["now"].alias("now"), empty(kind)), one), lambda y: F.struct(y["now"].alias("now"), F.array_append(s["out"], y["out"]).alias("out")))
    whole = F.flatten(F.aggregate(_let(steps, cut), F.struct(start.cast(kind).alias("now"), empty(f"array<{kind}>")), part, lambda s: s["out"]))
    return F.when(F.size(steps) > 0, whole).otherwise(F.array().cast(f"array<{kind}>"))


def running_product(ratio: Column, w) -> Column:
    """The product of positive ratios over a window; null counts as 1."""
    return F.exp(F.sum(F.coalesce(F.ln(ratio), F.lit(0.0))).over(w))
