"""A scan of a store's files, one for each code: schema, nulls, prices, codes, continuity or sessions, by file."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import panel
from .store import file_system

#: The columns of each frequency and their classes.
DAILY = {"date": "date", "code": "string", "open": "number", "high": "number", "low": "number", "close": "number", "volume": "number", "amount": "number", "is_suspended": "boolean"}
MINUTE = {"datetime": "date", "code": "string", "open": "number", "high": "number", "low": "number", "close": "number", "volume": "number", "amount": "number"}
#: Files of unusual columns whose names reach the driver, at most; more are refused aloud.
MOST_ODD = 10_000


def type_class(kind: pa.DataType) -> str:
    """date, number, boolean or string, else the type's own name."""
    t = pa.types
    if t.is_dictionary(kind):
        kind = kind.value_type
    if t.is_date(kind) or t.is_timestamp(kind):
        return "date"
    if t.is_floating(kind) or t.is_integer(kind) or t.is_decimal(kind):
        return "number"
    return "boolean" if t.is_boolean(kind) else "string" if t.is_string(kind) or t.is_large_string(kind) else str(kind)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, columns, spark_schema, n_rows, error) of each parquet file under a path; the footers are read in the tasks.

    columns maps each column to its class.  A file that can't be read has an error and no columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        for batch in batches:
            out = []
            for p in batch.column("path").to_pylist():
                try:
                    where, name = file_system(p)
                    with where.open_input_file(name) as f:
                        meta = pq.ParquetFile(f)
                        own = meta.schema_arrow
                        out.append((p, {c.name: type_class(c.type) for c in own}, from_arrow_schema(own).json(), meta.metadata.num_rows, None))
                except Exception as e:  # noqa: BLE001 - whatever is wrong with a file becomes a finding
                    out.append((p, {}, None, None, f"{type(e).__name__}: {e}"[:200]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([list(v.items()) for v in c] if i == 1 else list(c), k) for i, (c, k) in enumerate(zip(cols, kinds, strict=True))], ["path", "columns", "spark_schema", "n_rows", "error"])

    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    found = listed.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(run, "path string, columns map<string,string>, spark_schema string, n_rows long, error string")
    return found.withColumn("file", F.regexp_extract("path", r"([^/]+)\.[A-Za-z]+$", 1))


def schema_scan(found: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(file, check, detail, n): columns that are missing or of another class, files that can't be read or are empty; n is 1."""
    own = lambda c: F.try_element_at("columns", F.lit(c))
    what = [F.when(own(c).isNull(), F.lit(f"{c} missing")).when(own(c) != k, F.concat(F.lit(f"{c} is "), own(c), F.lit(f" instead of {k}"))) for c, k in expected.items()]
    unread = F.when(F.col("error").isNotNull(), F.array(F.struct(F.lit("unreadable").alias("check"), F.col("error").alias("detail")))).when(F.col("n_rows") == 0, F.array(F.struct(F.lit("empty").alias("check"), F.lit("no rows").alias("detail"))))
    wrong = F.transform(F.filter(F.array(*what), lambda x: x.isNotNull()), lambda x: F.struct(F.lit("schema").alias("check"), x.alias("detail")))
    return found.select("file", F.explode(F.coalesce(unread, wrong)).alias("f")).select("file", "f.check", "f.detail", F.lit(1).cast("long").alias("n"))


def _rows(spark: SparkSession, found: DataFrame, path: str, expected: dict[str, str]) -> DataFrame:
    """The rows of all readable files in the expected columns, with `file`; what does not cast, or is not there, is null.

    Files are read by groups of equal columns: the largest group by its path without the others, the others by name.
    """
    good = found.where("error is null and n_rows > 0")
    groups = good.groupBy("spark_schema").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "spark_schema").limit(1).collect()
    kinds = {"date": "timestamp" if "datetime" in expected else "date", "number": "double", "boolean": "boolean", "string": "string"}
    if not groups:
        return spark.createDataFrame([], ", ".join(f"{c} {kinds[k]}" for c, k in expected.items()) + ", file string, arrived struct<t:timestamp,f:string,i:long>, _has array<string>")
    odd = found.where(F.col("spark_schema").isNull() | (F.col("spark_schema") != groups[0].spark_schema) | (F.col("n_rows") == 0)).select("path", "spark_schema", "n_rows").limit(MOST_ODD + 1).collect()
    if len(odd) > MOST_ODD:
        raise ValueError(f"more than {MOST_ODD} files have other columns than most")
    parts = [(groups[0].spark_schema, [])]
    parts += [(s, sorted(r.path for r in odd if r.spark_schema == s and r.n_rows)) for s in sorted({r.spark_schema for r in odd if r.spark_schema and r.n_rows})]
    out = None
    for schema, names in parts:
        own = StructType.fromJson(json.loads(schema))
        name = F.col("_metadata.file_path")
        rows = spark.read.schema(own).parquet(*names) if names else spark.read.schema(own).option("pathGlobFilter", "*.parquet").parquet(path)
        if not names and odd:
            rows = rows.where(~F.regexp_extract(name, r"([^/]+)$", 1).isin([r.path.rsplit("/", 1)[-1] for r in odd]))
        cast = [F.expr(f"try_cast(`{c}` as {kinds[k]})").alias(c) if c in own.names else F.lit(None).cast(kinds[k]).alias(c) for c, k in expected.items()]
        seq = F.struct(F.col("_metadata.file_modification_time").alias("t"), name.alias("f"), F.col("_metadata.row_index").alias("i"))
        part = rows.select(*cast, F.regexp_extract("_metadata.file_name", r"(.+)\.[A-Za-z]+$", 1).alias("file"), seq.alias("arrived"), F.array(*(F.lit(c) for c in own.names)).alias("_has"))
        out = part if out is None else out.union(part)
    return out


def findings(spark: SparkSession, path: str, calendar: DataFrame | None = None, minutes: bool = False, period: int = 1) -> DataFrame:
    """(file, check, detail, n) of all checks over the files of one frequency, a file's name being its code.

    schema, unreadable and empty come from the footers; nulls (of columns that the file has), price logic, code, and
    repeats from the rows; continuity (daily, with a calendar), sessions, order (by place in the file) and
    grades (days of a doubtful or bad number of bars; minutes).  A file without a finding has no row.
    """
    expected = MINUTE if minutes else DAILY
    found = footers(spark, path)
    rows = _rows(spark, found, path, expected)
    by_file = rows.withColumn("own", F.col("code")).withColumn("code", F.col("file"))
    time = "datetime" if minutes else "date"
    count = lambda name, detail, n: F.struct(F.lit(name).alias("check"), detail.alias("detail"), n.cast("long").alias("n"))
    own = by_file.groupBy("file").agg(
        *(F.count_if(F.col(c).isNull() & F.array_contains("_has", c)).alias(f"null_{c}") for c in (time, *panel.PRICES, "volume", "amount")),
        F.count_if(F.coalesce(F.col("high") < F.greatest("low", "open", "close"), F.lit(False)) | F.coalesce(F.col("low") > F.least("high", "open", "close"), F.lit(False))).alias("prices"),
        F.count_if(F.coalesce(F.col("volume") < 0, F.lit(False)) | F.coalesce(F.col("amount") < 0, F.lit(False))).alias("negative"),
        (F.count(time) - F.count_distinct(time)).alias("repeats"),
        F.count_distinct("own").alias("n_codes"), F.max("own").alias("one"), F.max(F.array_contains("_has", "code")).alias("coded"),
    )
    checks = [count("nulls", F.lit(c), F.col(f"null_{c}")) for c in (time, *panel.PRICES, "volume", "amount")]
    checks += [count("price logic", F.lit("prices"), F.col("prices")), count("price logic", F.lit("negative"), F.col("negative")), count("repeats", F.lit(time), F.col("repeats"))]
    code = F.when(F.col("n_codes") == 0, F.lit("no code")).when(F.col("n_codes") > 1, F.lit("several codes")).when(F.upper("one") != F.upper("file"), F.concat(F.lit("code "), F.col("one")))
    checks += [count("code", code, F.when(F.col("coded") & code.isNotNull(), 1).otherwise(0))]
    out = schema_scan(found, expected).union(own.select("file", F.explode(F.array(*checks)).alias("f")).select("file", "f.*").where("n > 0"))
    tell = lambda df, name, detail, n: df.select(F.col("code").alias("file"), F.lit(name).alias("check"), F.lit(detail).alias("detail"), n.cast("long").alias("n")).where("n > 0")
    if minutes:
        sessions = panel.session_check(by_file.where("datetime is not null"), "arrived")
        grades = panel.minute_grades(by_file.where("datetime is not null"), period).where("grade in ('suspect', 'bad')").groupBy("code").agg(F.count("*").alias("n"))
        return out.union(tell(sessions, "sessions", "outside", F.col("outside"))).union(tell(sessions, "order", "inversions", F.col("inversions"))).union(tell(grades, "grades", "days", F.col("n")))
    if calendar is not None:
        gaps = panel.continuity(by_file.where("date is not null").select("code", "date").distinct(), calendar)
        out = out.union(tell(gaps, "continuity", "off the calendar", F.col("off_calendar"))).union(tell(gaps, "continuity", "longest gap", F.when(F.col("flagged"), F.col("longest_gap")).otherwise(0)))
    return out


def summary(found: DataFrame, of: DataFrame) -> DataFrame:
    """One row: files, passed (without a finding) and findings, from footers() and findings()."""
    bad = of.groupBy("file").agg(F.count("*").alias("k"))
    return found.select("file").join(bad, "file", "left").agg(F.count("*").alias("files"), F.count_if(F.col("k").isNull()).alias("passed"), F.coalesce(F.sum("k"), F.lit(0)).alias("findings"))
