"""Security master, industries and worklists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import board, parse_date, standard_code
from .panel import shift_days

VALID = r"^\d{6}\.(SH|SZ|BJ)$"


def build(raw: DataFrame) -> DataFrame:
    """One row for each well-formed code: dates parsed, exchange and board derived; the latest listing wins."""
    rows = raw.withColumn("code", standard_code(F.col("code"))).where(F.col("code").rlike(VALID))
    rows = rows.withColumns({"list_date": parse_date(F.col("list_date").cast("string")), "delist_date": parse_date(F.col("delist_date").cast("string")), "exchange": F.substring("code", 8, 2), "board": board(F.col("code"))})
    w = W.partitionBy("code").orderBy(F.desc_nulls_last("list_date"), "name")
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def merge(listed: DataFrame, delisted: DataFrame) -> DataFrame:
    """The union, one row for each code: a record with a delisting date, the latest, wins."""
    both = listed.withColumn("_o", F.lit(0)).unionByName(delisted.withColumn("_o", F.lit(1)))
    w = W.partitionBy("code").orderBy(F.desc_nulls_last("delist_date"), "_o", "name")
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_o")


def increments(snapshots: DataFrame, seq: str) -> DataFrame:
    """The last snapshot's row of each well-formed code."""
    w = W.partitionBy("code").orderBy(F.desc(seq))
    return snapshots.where(F.col("code").rlike(VALID)).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def industries(primary: DataFrame, second: DataFrame) -> DataFrame:
    """The first feed's industries, the second's only where one is missing; blanks are missing."""
    tidy = lambda d: d.select("code", F.nullif(F.trim("industry"), F.lit("")).alias("industry")).where("industry is not null").groupBy("code").agg(F.min("industry").alias("industry"))
    a = tidy(primary)
    return a.unionByName(tidy(second).join(a, "code", "left_anti"))


def gaps(wanted: list[DataFrame], held: DataFrame) -> DataFrame:
    """Codes of any wanted table that are not held."""
    rows = wanted[0].select("code")
    for w in wanted[1:]:
        rows = rows.union(w.select("code"))
    return rows.distinct().join(held.select("code").distinct(), "code", "left_anti")


#: The first days to fetch.
EARLIEST, EARLIEST_MINUTE, SESSION_END = "1990-12-19", "2000-01-01", "15:00"


def next_start(bars: DataFrame, codes: DataFrame, calendar: DataFrame, minute: bool = False) -> DataFrame:
    """(code, start, until): the days to fetch, up to the last trading day or the delisting; codes with nothing to fetch are left out.

    Codes delisted with data are complete.  Of minute bars (`datetime`) a day that lacks its last session minute is fetched again.
    """
    time = F.col("datetime" if minute else "date")
    seen = bars.groupBy("code").agg(F.max(time).alias("_t")).select("code", F.col("_t").cast("date").alias("date"), (F.date_format("_t", "HH:mm") >= SESSION_END if minute else F.lit(True)).alias("_whole"))
    last = codes.select("code", "delist_date").join(seen, "code", "left").where("date is null or delist_date is null")
    moved = shift_days(last.select("date").where("date is not null").distinct(), calendar, 1)
    first = F.lit(EARLIEST_MINUTE if minute else EARLIEST).cast("date")
    start = F.when(F.col("date").isNull(), first).when(F.col("_whole"), F.col("shifted")).otherwise(F.col("date"))
    rows = last.join(moved, "date", "left").crossJoin(calendar.agg(F.max("date").alias("_last")))
    return rows.select("code", start.alias("start"), F.least("_last", "delist_date").alias("until")).where("start <= until")


def delisted(raw: DataFrame) -> DataFrame:
    """(code, delist_date) of records with status D or a delisting date; dates that can't be read go."""
    status = F.upper(F.trim("status")) == "D" if "status" in raw.columns else F.lit(False)
    text = F.trim(F.col("delist_date").cast("string"))
    rows = raw.where(F.coalesce(status, F.lit(False)) | F.coalesce(text != "", F.lit(False)))
    return rows.select("code", parse_date(text).alias("delist_date")).where("delist_date is not null")


def code_list(parts: list[DataFrame]) -> DataFrame:
    """(code, place): the codes of several tables (code, position), one after the other, each at its first place from 1."""
    rows = None
    for i, part in enumerate(parts):
        own = part.select("code", F.lit(i).alias("_part"), "position")
        rows = own if rows is None else rows.union(own)
    first = rows.groupBy("code").agg(F.min(F.struct("_part", "position")).alias("_at"))  # a list of indices: one task numbers it
    return first.select("code", F.row_number().over(W.orderBy("_at", "code")).cast("long").alias("place"))
