"""Late and corrected bars: an upsert, in batch and as a stream into a store of monthly parts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.panel import last_arrived


def upsert(stored: DataFrame, arrived: DataFrame, keys: tuple[str, ...] = ("code", "date"), seq: str = "ingest_seq", ties: bool = False) -> DataFrame:
    """Stored and new rows, one for each key: the last to arrive; of rows with the same arrival number the new one, then the one of largest hash.

    With `ties` all rows of a key's highest arrival number stay.
    """
    if ties:
        last = F.max(seq).over(W.partitionBy(*keys))
        return stored.unionByName(arrived).withColumn("_last", last).where(F.col(seq) == F.col("_last")).drop("_last")
    other = [F.col(f"`{c}`") for c in arrived.columns]
    rows = stored.withColumn("_new", F.lit(0)).unionByName(arrived.withColumn("_new", F.lit(1)))
    order = F.struct(F.col(seq), F.col("_new"), F.xxhash64(F.to_json(F.struct(*other))))
    return last_arrived(rows.withColumn("_order", order), list(keys), "_order").drop("_order", "_new")


class Store:
    """A folder of bars in monthly parts.  A manifest names the folder of each part; each is a whole snapshot of its own.

    `data/<folder>/part=<month>` are never changed.  `manifest/<number>` holds (part, folder) for all parts;
    the highest number counts, and its folder appears by one rename.  `vacuum` drops what the last `keep`
    manifests don't name, so that the store stays as large as its rows.  `writer` names the only stream that
    may write; it is created at once or not at all.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")
        self.files = self._path("x").getFileSystem(conf)

    def names(self, folder: str) -> list[str]:
        """What lies in a folder; one entry for each month or kept version."""
        where = self._path(folder)
        return sorted(s.getPath().getName() for s in self.files.listStatus(where)) if self.files.exists(where) else []

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.names("manifest") if n.isdigit())

    def parts(self, number: int | None = None) -> dict[str, str]:
        """The folder of each part in a version, the last by default: a row for each month."""
        known = self.versions()
        if not known:
            return {}
        rows = self.spark.read.schema("part string, folder string").parquet(f"{self.path}/manifest/{known[-1] if number is None else number}").collect()
        return {r.part: r.folder for r in rows}

    def read(self, schema, months: list[str] | None = None) -> DataFrame:
        """The rows of all parts, or of some months; empty before the first."""
        folders = [f"{self.path}/data/{f}/part={p}" for p, f in self.parts().items() if months is None or p in months]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def claim(self, writer: str) -> None:
        """Makes `writer` the store's only one; refuses when another is."""
        where = self._path("writer")
        try:
            out = self.files.create(where, False)
        except Exception as e:
            if not self.files.exists(where):
                raise
            held = self.spark.read.text(f"{self.path}/writer").first()
            if held is None or held[0] != writer:
                raise RuntimeError(f"{self.path} belongs to the stream of {held and held[0]}; release it first") from e
            return
        out.write(bytearray(writer.encode()))
        out.close()

    def release(self) -> None:
        """Lets another stream write from now on."""
        self.files.delete(self._path("writer"), False)

    def put(self, rows: DataFrame, months: list[str], month, number: int, keep: int = 2) -> None:
        """Writes the parts of `months` anew as a further version and drops what no kept version names."""
        folder = f"{number}-{uuid.uuid4().hex}"
        rows.withColumn("part", month).repartition("part").write.partitionBy("part").parquet(f"{self.path}/data/{folder}")
        after = self.parts() | dict.fromkeys(months, folder)
        version = (self.versions() or [-1])[-1] + 1
        draft = f"drafts/{folder}"
        self.spark.createDataFrame(sorted(after.items()), "part string, folder string").coalesce(1).write.parquet(f"{self.path}/{draft}")
        self.files.mkdirs(self._path("manifest"))
        if self.files.exists(self._path(f"manifest/{version}")) or not self.files.rename(self._path(draft), self._path(f"manifest/{version}")):
            raise RuntimeError(f"version {version} of {self.path} was written by another")
        self.vacuum(keep)

    def vacuum(self, keep: int = 2) -> int:
        """Drops all manifests but the last `keep`, the parts that these don't name and unfinished drafts; says how many."""
        known = self.versions()
        gone = 0
        for n in known[:-keep]:
            gone += self.files.delete(self._path(f"manifest/{n}"), True)
        named = {(f, p) for n in known[-keep:] for p, f in self.parts(n).items()}
        for folder in self.names("data"):
            parts = {p.removeprefix("part=") for p in self.names(f"data/{folder}") if p.startswith("part=")}
            old = [p for p in parts if (folder, p) not in named]
            for p in [] if len(old) == len(parts) else old:
                gone += self.files.delete(self._path(f"data/{folder}/part={p}"), True)
            if len(old) == len(parts):
                gone += self.files.delete(self._path(f"data/{folder}"), True)
        self.files.delete(self._path("drafts"), True)
        return gone


def current(spark: SparkSession, store: str, schema) -> DataFrame:
    """The store's rows; empty before the first."""
    return Store(spark, store).read(schema)


def stream_upsert(spark: SparkSession, source: str, store: str, checkpoint: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Upserts all new files of `source` into `store`, one micro-batch at a time, and gives the store's rows.

    Only the months that a micro-batch touches are written anew.  The store, not the driver, knows the versions,
    so that a restart goes on where the last run stopped; a micro-batch that runs again upserts the same rows
    and changes nothing.  The store belongs to the stream of `checkpoint`; another is refused.
    """

    def batch(new: DataFrame, number: int) -> None:
        month = F.date_format("date", "yyyy-MM")
        touched = [r.part for r in new.select(month.alias("part")).distinct().collect()]  # a row for each month
        if touched:
            own = Store(new.sparkSession, store)
            own.put(upsert(own.read(schema, touched), new), touched, month, number)

    Store(spark, store).claim(checkpoint)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return current(spark, store, schema)
