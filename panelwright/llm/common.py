"""What the operators of this subpackage share: batches, the shared folder, components of links."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PIECE_BYTES = 2 << 20
BATCH_BYTES = 8 << 20
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open: dict[int, list[list[str]]] = {}  # of each thread, the folders written in each settled() it is in


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where the setting is unset and everything runs in one process (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = getattr(spark, "_shared_folder_for_tests", None) or tempfile.mkdtemp(prefix="shared-")
        spark._shared_folder_for_tests = where
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Spark drops the shuffle files of each action inside when it ends, and hands rows to Python in batches of BATCH_BYTES or one longer row.

    The session's own settings return afterwards.  Spark's 64 MB a batch lie in the JVM, outside its heap, and in
    the worker at once, for each core.
    """
    before = {k: spark.conf.get(k, None) for k in (CLEANUP, BATCH)}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, str(min(BATCH_BYTES, int(before[BATCH] or BATCH_BYTES))))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    _owned(path)
    return out


def _owned(path: str) -> None:
    if scopes := _open.get(threading.get_ident()):
        scopes[-1].append(path)


def _delete(spark: SparkSession, *folders: str) -> None:
    for folder in folders:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table.folder)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() gives, written; the tables that were written to make it are dropped, also where it fails."""
    scopes = _open.setdefault(threading.get_ident(), [])
    mine: list[str] = []
    scopes.append(mine)
    out = None
    try:
        out = written(make(), name)
    finally:
        scopes.pop()
        if not scopes:
            del _open[threading.get_ident()]
        _delete(SparkSession.active(), *(f for f in mine if out is None or f != out.folder))
    _owned(out.folder)
    return out


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that a piece holds about `limit` bytes of text, or one longer row."""
    for batch in batches:
        col = batch.column(column)
        ends = col.value_lengths() if isinstance(col, (pa.ListArray, pa.LargeListArray)) else None
        if ends is None:
            ends = pc.fill_null(pc.binary_length(col), 0)
        size, lo, total = ends.to_numpy(zero_copy_only=False), 0, 0
        for i, n in enumerate(size):
            if total and total + n > limit:
                yield batch.slice(lo, i - lo)
                lo, total = i, 0
            total += int(n) + 16
        if lo < len(size):
            yield batch.slice(lo)


def per_piece(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, column: str = "text") -> DataFrame:
    """`work` on each piece of the table, inside Spark's tasks; the columns follow `schema`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, column):
            out = work(piece)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node's smallest reachable node, for every node of the edges (a, b) but roots.

    Alternates large-star and small-star rounds (grouped minima and joins, no group is gathered), each
    round checkpointed in the shared folder.  Repeated edges, loops and nulls are ignored.
    """
    spark = edges.sparkSession
    shared_folder(spark)
    ordered = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    with tidy(spark):
        now = ordered(edges).checkpoint()
        seen = mark(now)
        while seen[0]:
            both = now.union(now.select("b", "a"))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = ordered(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            now = ordered(small.union(low.select("a", F.col("m").alias("b")))).checkpoint()
            before, seen = seen, mark(now)
            if before == seen:
                break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
