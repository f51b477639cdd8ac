"""Reading and writing panel tables, binary bar files and vendor feeds."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..functions.columns import standard_code

#: The layout of a daily record, and of a minute record (32 bytes each).
DAY = np.dtype([("date", "<u4"), ("open", "<u4"), ("high", "<u4"), ("low", "<u4"), ("close", "<u4"), ("amount", "<f4"), ("volume", "<u4"), ("pad", "<u4")])
MINUTE = np.dtype([("date", "<u2"), ("time", "<u2"), ("open", "<f4"), ("high", "<f4"), ("low", "<f4"), ("close", "<f4"), ("amount", "<f4"), ("volume", "<u4"), ("pad", "<u4")])

EPOCH = dt.date(1970, 1, 1)

#: Security classes by exchange and the two digits after it.
CLASSES = {
    "sz": {"A_STOCK": ["00", "30"], "B_STOCK": ["20"], "INDEX": ["39"], "FUND": ["15", "16"], "BOND": ["10", "11", "12", "13", "14"]},
    "sh": {"A_STOCK": ["60", "68"], "B_STOCK": ["90"], "INDEX": ["00", "88", "99"], "FUND": ["50", "51"], "BOND": ["01", "10", "11", "12", "13", "14"]},
}


def sourced(bars: DataFrame) -> DataFrame:
    """Rows without a source, or all where the column is absent, are `legacy`."""
    return bars.withColumn("source", F.coalesce("source", F.lit("legacy")) if "source" in bars.columns else F.lit("legacy"))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return sourced(spark.read.parquet(path))


def write_bars(bars: DataFrame, path: str, mode: str = "append") -> None:
    bars.withColumn("year", F.year("date")).repartition("year").write.partitionBy("year").mode(mode).option("compression", "snappy").parquet(path)


def file_system(path: str) -> tuple:
    """Arrow's file system of a path or URI, and the path in it."""
    from pyarrow import fs

    uri = path if "://" in path else f"file://{path.removeprefix('file:')}"
    return fs.FileSystem.from_uri(uri)


def write_files(rows: DataFrame, path: str, file: str = "file", column_types: dict[str, pa.DataType] | None = None) -> None:
    """A store of one parquet file for each value of the column `file` (which is left out), each written by one task.

    Arrow opens the path; a file holds one code's rows, whose number follows the calendar.  A file appears by a rename.
    """

    def put(part: pa.Table) -> pa.Table:
        import pyarrow.parquet as pq

        name = part.column(file)[0].as_py()
        own = part.drop_columns([file])
        for c, kind in (column_types or {}).items():
            own = own.set_column(own.schema.get_field_index(c), c, own.column(c).cast(kind))
        where, root = file_system(path)
        where.create_dir(root, recursive=True)
        draft = f"{root}/.{name}-{uuid.uuid4().hex}"
        with where.open_output_stream(draft) as out:
            pq.write_table(own, out)
        where.move(draft, f"{root}/{name}.parquet")
        return pa.table({"file": [name], "n": pa.array([part.num_rows], pa.int64())})

    rows.groupBy(file).applyInArrow(put, "file string, n long").write.format("noop").mode("overwrite").save()


def write_binary(bars: DataFrame, path: str) -> None:
    """Daily bars as files of 32-byte records, one for each code, in date order: read_binary() reads them."""

    def put(part: pa.Table) -> pa.Table:
        part = part.sort_by("date")
        name = part.column("name")[0].as_py()
        price, volume = UNITS.get(class_of(name), UNITS[""])
        a = np.zeros(part.num_rows, DAY)
        days = part.column("date").to_numpy().astype("datetime64[D]")
        month = days.astype("datetime64[M]").astype(np.int64)
        a["date"] = (1970 + month // 12) * 10000 + (month % 12 + 1) * 100 + (days - days.astype("datetime64[M]")).astype(np.int64) + 1
        for c, unit in [(c, price) for c in ("open", "high", "low", "close")] + [("amount", None), ("volume", volume)]:
            x = part.column(c).to_numpy()
            a[c] = x if unit is None else np.floor(x / unit + 0.5)
        where, root = file_system(path)
        where.create_dir(root, recursive=True)
        with where.open_output_stream(f"{root}/{name}.day") as out:
            out.write(a.tobytes())
        return pa.table({"name": [name], "n": pa.array([len(a)], pa.int64())})

    halves = F.split("code", r"\.")
    named = bars.where(halves[1].isin("SH", "SZ", "BJ")).select(F.concat(F.lower(halves[1]), halves[0]).alias("name"), "date", *FIELDS)
    named.groupBy("name").applyInArrow(put, "name string, n long").write.format("noop").mode("overwrite").save()


def tidy_factors(raw: DataFrame) -> DataFrame:
    """Factor rows with date and number; others go."""
    return raw.select("code", F.expr("try_cast(date as date)").alias("date"), F.expr("try_cast(cum_factor as double)").alias("cum_factor")).dropna(subset=["date", "cum_factor"])


def write_factors(raw: DataFrame, path: str) -> bool:
    """Writes tidy_factors() of the rows and says whether there were any: without one nothing is written."""
    rows = tidy_factors(raw)
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").parquet(path)
    return True


def effective_factors(own: DataFrame, external: DataFrame) -> DataFrame:
    """A code's own factors if it has any, else the external ones."""
    return own.unionByName(external.join(own.select("code").distinct(), "code", "left_anti"))


def _snapshot(file_name: Column) -> Column:
    """The day that a membership file's name YYYYMMDD.* says; null for other names."""
    return F.try_to_timestamp(F.regexp_extract(file_name, r"^(\d{8})\.", 1), F.lit("yyyyMMdd")).cast("date")


def index_members(spark: SparkSession, path: str) -> DataFrame:
    """Membership files named YYYYMMDD.parquet, with their date; other files are ignored, and a filter on the date leaves the others unread."""
    name = F.col("_metadata.file_name")
    return spark.read.parquet(path).where(_snapshot(name).isNotNull()).select("*", _snapshot(name).alias("snapshot_date"))


def index_members_at(spark: SparkSession, path: str, day: str) -> DataFrame:
    """The whole latest snapshot up to a day, empty before the first: the listing names it and only its file is read."""
    listed = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    last = listed.select(_snapshot(F.col("file")).alias("d")).where(F.col("d") <= F.lit(day).cast("date")).agg(F.max("d")).first()[0]
    stem = last.strftime("%Y%m%d") if last else ""
    return spark.read.parquet(path).where(F.col("_metadata.file_name").startswith(f"{stem}.")).select("*", F.lit(last).cast("date").alias("snapshot_date"))


def read_arrivals(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Bars with `ingest_seq`, the order in which their rows arrived: by their file's time, its name and their place in it."""
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.parquet(path)
    return rows.select("*", F.struct("_metadata.file_modification_time", "_metadata.file_name", "_metadata.row_index").alias("ingest_seq"))


def security_class(file_name: Column) -> Column:
    """Exchange and class from a vendor's file name; null when unknown."""
    ex, head = F.lower(F.substring(file_name, 1, 2)), F.substring(file_name, 3, 2)
    out = F.when(ex == "bj", "BJ_A_STOCK")
    for exchange, classes in CLASSES.items():
        for name, heads in classes.items():
            out = out.when((ex == exchange) & head.isin(heads), f"{exchange.upper()}_{name}")
    return out


#: Price and volume units by class; classes not named have the first.
UNITS = {"": (0.01, 1.0), "SH_B_STOCK": (0.001, 1.0), "SH_FUND": (0.001, 1.0), "SH_BOND": (0.001, 1.0), "SZ_FUND": (0.001, 0.01), "SZ_BOND": (0.001, 0.01)}


def class_of(file_name: str) -> str | None:
    """security_class() of one name."""
    ex, head = file_name[:2].lower(), file_name[2:4]
    if ex == "bj":
        return "BJ_A_STOCK"
    return next((f"{ex.upper()}_{c}" for c, heads in CLASSES.get(ex, {}).items() if head in heads), None)


class FixedWidthBars(DataSource):
    """`fixed_width_bars`: files of 32-byte records under `path`, cut into ranges of `records` records, each read by a task of its own.

    Where there are more than MOST_TASKS ranges, those beside each other share a task, up to TASK_RECORDS records.

    Options: path (a local one or a URI that Arrow's file systems open), kind (`day` or `minute`), records, rates
    (JSON of price and volume units by class).  Only the columns of the schema asked for are decoded, and
    filters on `date` are applied to the raw records.  Records without a real date, other files and
    what is left behind the last whole record are passed over.
    """

    @classmethod
    def name(cls) -> str:
        return "fixed_width_bars"

    def schema(self) -> str:
        return BINARY_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FixedWidthReader(schema, dict(self.options))


BINARY_SCHEMA = "raw_code string, date date, minute int, open double, high double, low double, close double, amount double, volume double"


#: Ranges that each have a task of their own, and records of neighbouring ones that share a task.
MOST_TASKS, TASK_RECORDS = 64, 1 << 18


@dataclass
class _Ranges(InputPartition):
    """(path, first record, records) of each range."""

    ranges: list[tuple[str, int, int]]


class _FixedWidthReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.options, self.bounds = schema.fieldNames(), options, []
        self.kind = options.get("kind", "day")
        self.record = DAY if self.kind == "day" else MINUTE

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802 - the interface's name
        held = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in held and f.attribute == ("date",):
                self.bounds.append((held[type(f)], (f.value - EPOCH).days))
            else:
                yield f

    def _open(self) -> tuple:
        return file_system(self.options["path"])

    def partitions(self) -> list[_Ranges]:
        from pyarrow import fs

        where, root = self._open()
        info = where.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(root, recursive=True))
        ends = (".day",) if self.kind == "day" else (".lc1", ".lc5")
        step, out = int(self.options.get("records", 1 << 20)), []
        for f in sorted(files, key=lambda f: f.path):
            if f.type == fs.FileType.File and f.path.endswith(ends) and (self.kind == "minute" or class_of(f.base_name)):
                n = f.size // self.record.itemsize
                out += [(f.path, at, min(step, n - at)) for at in range(0, n, step)]
        each = max(1, min(-(-len(out) // MOST_TASKS), TASK_RECORDS // step))
        return [_Ranges(out[at : at + each]) for at in range(0, len(out), each)] or [_Ranges([])]

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        where, _ = self._open()
        for path, ranges in groupby(partition.ranges, key=lambda r: r[0]):
            with where.open_input_file(path) as f:
                for _, first, count in ranges:
                    f.seek(first * self.record.itemsize)
                    yield from self._decoded(path, np.frombuffer(f.read(count * self.record.itemsize), self.record))

    def _decoded(self, path: str, a: np.ndarray) -> Iterator[pa.RecordBatch]:
        d = a["date"].astype(np.int64)
        year, month, day = (d // 10000, d // 100 % 100, d % 100) if self.kind == "day" else (d // 2048 + 2004, d % 2048 // 100, d % 2048 % 100)
        month0 = (year - 1970) * 12 + np.clip(month, 1, 12) - 1
        start, after = (m.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) for m in (month0, month0 + 1))
        days = start + day - 1
        ok = (year >= 1) & (year <= 9999) & (month >= 1) & (month <= 12) & (day >= 1) & (days < after)
        if self.kind == "minute":
            ok &= a["time"] < 1440
        for how, bound in self.bounds:
            ok &= {"==": np.equal, ">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal}[how](days, bound)
        a, days = a[ok], days[ok]
        name = path.rsplit("/", 1)[-1]
        price, volume = self._units(name)
        make = {"raw_code": lambda: pa.array([name[:8]] * len(a), pa.string()), "date": lambda: pa.array(days.astype(np.int32), pa.int32()).cast(pa.date32())}
        make["minute"] = lambda: pa.array(a["time"].astype(np.int32) if self.kind == "minute" else np.zeros(len(a), np.int32))
        for c, unit in [(c, price) for c in ("open", "high", "low", "close")] + [("amount", 1.0), ("volume", volume)]:
            make[c] = lambda c=c, unit=unit: pa.array(a[c].astype(float) * unit)
        if len(a):
            yield pa.RecordBatch.from_arrays([make[c]() for c in self.columns], self.columns)

    def _units(self, name: str) -> tuple[float, float]:
        if self.kind == "minute":
            return 1.0, 1.0
        kind = class_of(name)
        rates = json.loads(self.options.get("rates", "{}"))
        return rates.get(kind) or UNITS.get(kind, UNITS[""])


def _fixed_width(spark: SparkSession, path: str, kind: str, columns: list[str], records: int, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FixedWidthBars)
    all_of = {f.name: f for f in StructType.fromDDL(BINARY_SCHEMA)}
    return spark.read.format("fixed_width_bars").schema(StructType([all_of[c] for c in columns])).options(path=path, kind=kind, records=records, **options).load()


FIELDS = ["open", "high", "low", "close", "amount", "volume"]


def read_binary(spark: SparkSession, path: str, rates: dict[str, tuple[float, float]] | None = None, fields: list[str] = FIELDS, records: int = 1 << 20) -> DataFrame:
    """Bars (code, date and the fields asked for) of all `.day` files under a path; a batch holds `records` records of a file at most."""
    rows = _fixed_width(spark, path, "day", ["raw_code", "date", *fields], records, rates=json.dumps(rates or {}))
    return rows.select(standard_code(F.col("raw_code")).alias("code"), "date", *fields)


def read_binary_minutes(spark: SparkSession, path: str, fields: list[str] = FIELDS, records: int = 1 << 20) -> DataFrame:
    """Minute bars of all `.lc1` and `.lc5` files under a path, in real prices and shares."""
    rows = _fixed_width(spark, path, "minute", ["raw_code", "date", "minute", *fields], records)
    stamp = F.expr("cast(date as timestamp) + make_dt_interval(0, minute div 60, minute % 60)")
    return rows.select(standard_code(F.col("raw_code")).alias("code"), stamp.alias("datetime"), *fields)


#: A feed's columns by ours, and its units.
FEEDS = {
    "plain": ({"date": "date", "open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume", "amount": "amount"}, 1.0, 1.0),
    "lots": ({"date": "date", "open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume", "amount": "amount"}, 100.0, 1.0),
    "thousands": ({"date": "trade_date", "open": "open", "high": "high", "low": "low", "close": "close", "volume": "vol", "amount": "amount"}, 100.0, 1000.0),
}


def normalise_feed(raw: DataFrame, feed: str) -> DataFrame:
    """A vendor's rows in our columns and units; missing columns are null, rows without a date go."""
    names, volume, amount = FEEDS[feed]
    scale = {"volume": volume, "amount": amount}
    number = lambda c: F.expr(f"try_cast(`{names[c]}` as double)") * scale.get(c, 1.0) if names[c] in raw.columns else F.lit(None).cast("double")
    halted = F.coalesce(F.col("tradestatus") == "0", F.lit(False)) if "tradestatus" in raw.columns else F.lit(False)
    rows = raw.select("code", F.expr(f"try_cast(`{names['date']}` as date)").alias("date"), *(number(c).alias(c) for c in names if c != "date"), halted.alias("is_suspended"))
    return rows.where("date is not null").withColumn("raw_close", F.col("close"))


def first_feed(rows: DataFrame, keys: list[str], priority: str = "priority") -> DataFrame:
    """For each key only the rows of the first feed, by priority, that returned any."""
    return rows.withColumn("_p", F.min(priority).over(W.partitionBy(*keys))).where(F.col(priority) == F.col("_p")).drop("_p")


def write_equity(equity: DataFrame, path: str) -> None:
    equity.write.mode("overwrite").option("header", True).csv(path)
