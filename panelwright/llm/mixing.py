"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents, shuffled by a hash, form a stream of words cut into blocks of equal size; the
stream may be read twice.  Van der Corput points, mapped through the cumulative targets, name the
source of each slot; the slot's rank within its source names the block that fills it.  A block has at
most 1,024 words, so slots grow with the input; as points can miss a source smaller than a block, each
source is completed or cut to its target, to the word.  Running sums are taken per source and hash
bucket, so that no source is gathered in one task.  Windows over the sources alone hold one row
for each source.  Null texts have size 0; nulls are a source of their own, ordered last.  An empty
table gives an empty result.  Rows that repeat a doc_id are separate documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, EPOCHS, SLOTS, LEAST_BLOCK, MOST_BLOCK, CELL_SLOTS, BUCKETS, SEED = 1.5, 2, 1 << 18, 16, 1024, 4096, 512, 11


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sid, source, source_size, target: shares by weight, none above `epochs` times its source's size.

    `sources` has source and source_size.  With caps c and weights w the targets are min(c, level * w),
    the level being the one at which they sum to share * all sizes: what resharing the excess ends in.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("sid", F.row_number().over(order) - 1)
    pick = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    filled = ranked.withColumn("w", pick).withColumn("cap", F.col("source_size") * float(epochs))
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), "sid")
    falling = W.orderBy(F.desc(F.col("cap") / F.col("w")), F.desc("sid"))  # a frame up to the end would be summed anew for each row
    sums = filled.select(
        "*",
        F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("capped"),
        F.sum("w").over(falling.rowsBetween(W.unboundedPreceding, 0)).alias("open"),
        (F.sum("source_size").over(W.partitionBy()) * share).alias("total"),
    )
    # Were all sources before this one full, this would be the level; the first whose cap is not reached has the right one.
    level = sums.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    ratio = F.struct(F.col("cap") / F.col("w"), F.col("sid"))
    found = level.withColumn("level", F.min_by("level", F.when(F.col("level") * F.col("w") <= F.col("cap"), ratio)).over(W.partitionBy()))
    return found.select("sid", "source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), "cap").alias("target"))


def point(slot: Column) -> Column:
    """A slot's van der Corput point: its 52 lowest bits in reverse behind the binary point."""
    return F.conv(F.reverse(F.lpad(F.bin(slot), 52, "0")), 2, 10).cast("double") / 2.0**52


def placed(slots: DataFrame, sources: DataFrame, cells: int) -> DataFrame:
    """slots (slot, u) with the sid and limit of the source (sid, lo, hi, limit) that holds u, by a merged sort within equal cells of [0, 1).

    Points are spread evenly, so every cell has about as many; the source that reaches into a cell from before stands at its start.
    """
    row = lambda df, cell, u, kind, sid, limit, slot: df.select(cell.cast("long").alias("cell"), u.alias("u"), F.lit(kind).alias("kind"), sid.alias("sid"), limit.alias("limit"), slot.alias("slot"))
    no = F.lit(None).cast("long")
    starts = row(sources, F.floor(F.col("lo") * cells), F.col("lo"), 1, F.col("sid"), F.col("limit"), no)
    into = sources.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells) + 1, F.greatest(F.floor(F.col("lo") * cells) + 1, F.floor(F.col("hi") * cells))))).where(F.col("cell") <= F.col("hi") * cells)
    into = row(into, F.col("cell"), F.lit(-1.0), 0, F.col("sid"), F.col("limit"), no)
    points = row(slots, F.floor(F.col("u") * cells), F.col("u"), 2, F.lit(None).cast("int"), no, F.col("slot"))
    upto = W.partitionBy("cell").orderBy("u", "kind", "sid").rowsBetween(W.unboundedPreceding, 0)
    held = F.last(F.when(F.col("sid").isNotNull(), F.struct("sid", "limit")), ignorenulls=True).over(upto)
    return starts.union(into).union(points).withColumn("at", held).where("kind = 2").select("slot", "at.sid", "at.limit")


def schedule(target: DataFrame, slots: int = SLOTS, least_block: int = LEAST_BLOCK, most_block: int = MOST_BLOCK) -> tuple[DataFrame, int]:
    """(sid, block, limit) for each slot, and the words of a block; beyond slots * most_block words there are more slots."""
    spark = target.sparkSession
    total = target.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    size = min(max(least_block, -int(-total // slots)), max(least_block, most_block))
    n = round(total / size)
    share = W.orderBy("sid")
    top = F.sum("target").over(share) / F.lit(max(total, 1e-9))
    ends = target.select("sid", "target", top.alias("hi"), F.round("target").cast("long").alias("limit"), F.max("sid").over(W.partitionBy()).alias("last"))
    ends = ends.select("sid", F.lag("hi", 1, 0.0).over(share).alias("lo"), F.when(F.col("sid") == F.col("last"), 1.0).otherwise(F.col("hi")).alias("hi"), "limit", "target").where("target > 0")
    points = spark.range(n).select(F.col("id").alias("slot"), point(F.col("id")).alias("u"))
    at = placed(points, ends, max(1, n // CELL_SLOTS)).select("sid", "limit", "slot", F.shiftright("slot", 12).alias("part"))
    before = at.groupBy("sid", "part").count()
    before = before.select("sid", "part", (F.sum("count").over(W.partitionBy("sid").orderBy("part")) - F.col("count")).alias("before"))
    ranked = at.withColumn("own", F.row_number().over(W.partitionBy("sid", "part").orderBy("slot")) - 1)
    return ranked.join(before, ["sid", "part"]).select("sid", (F.col("before") + F.col("own")).alias("block"), "limit"), size


def completed(slots: DataFrame, target: DataFrame, size: int) -> DataFrame:
    """(sid, block, limit): the slots' blocks, those that a source lacks and none beyond its target; limit is the target in words."""
    need = F.ceil(F.col("limit") / size)
    whole = target.select("sid", F.round("target").cast("long").alias("limit"))
    lacks = whole.join(slots.groupBy("sid").count(), "sid", "left").select("sid", F.coalesce("count", F.lit(0)).cast("long").alias("has"), "limit").where(F.col("has") < need)
    return slots.where(F.col("block") * size < F.col("limit")).union(lacks.select("sid", F.explode(F.sequence("has", need - 1)).alias("block"), "limit"))


def mix(docs: DataFrame, seed: int = SEED, epochs: int = EPOCHS, **how) -> DataFrame:
    """A row for each document: doc_id, size, source, source_size, target, taken, sid, start, and copies.

    copies: for each reading of the stream that takes words of the document, (from, to): the first word
    taken and the one after the last, from 0.  `start` is the document's place in its source's stream.
    """
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    target = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), epochs=epochs, **how), "targets")
    slots, block = schedule(target)
    slots = completed(slots, target, block)
    named = target.withColumnRenamed("source", "name")
    mixed = sized.join(named, F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "size", "source", "sid", "source_size", "target")
    keyed = mixed.withColumn("key", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod("key", F.lit(BUCKETS)))
    sums = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("all"))
    sums = sums.select("sid", "bucket", (F.sum("all").over(W.partitionBy("sid").orderBy("bucket")) - F.col("all")).alias("before"))
    run = W.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    streams = keyed.withColumn("own", F.sum("size").over(run) - F.col("size")).join(sums, ["sid", "bucket"]).withColumn("start", F.col("before") + F.col("own")).drop("key", "bucket", "own", "before")
    read = streams.where("size > 0").select("sid", "start", "size", "source_size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda e: F.struct(e.alias("epoch"), (e * F.col("source_size") + F.col("start")).alias("lo")))).alias("e")).select("sid", "start", "size", "source_size", "e.epoch", "e.lo")
    parts = read.select("*", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("lo") + F.col("size") - 1) / block))).alias("block"))
    parts = parts.select("sid", "start", "source_size", "epoch", "block", (F.greatest("lo", F.col("block") * block) - F.col("lo")).alias("from"), (F.least(F.col("lo") + F.col("size"), (F.col("block") + 1) * block) - F.col("lo")).alias("to"))
    filled = parts.join(slots, ["sid", "block"]).withColumn("to", F.least("to", F.col("limit") - F.col("epoch") * F.col("source_size") - F.col("start"))).where("to > from")
    taken = filled.groupBy("sid", "start", "epoch").agg(F.sum(F.col("to") - F.col("from")).alias("n"), F.min("from").alias("from"), F.max("to").alias("to"))
    taken = taken.groupBy("sid", "start").agg(F.sum("n").alias("taken"), F.sort_array(F.collect_list(F.struct("epoch", "from", "to"))).alias("copies"))
    some = streams.where("size > 0").join(taken, ["sid", "start"], "left")
    none = streams.where("size = 0").select("*", F.lit(0).cast("long").alias("taken"), F.array().cast(dict(some.dtypes)["copies"]).alias("copies"))
    cols = ["doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "sid", "start", "copies"]
    return some.select(*cols).union(none.select(*cols))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of docs, whatever their names and types: a row for each reading that takes words of a document.

    A text taken whole is unchanged; of one cut by a block's end the taken words are joined by a space.
    Rows of one doc_id and size share their copies when they repeat a document.
    """
    key = ["doc_id", "size", "source", "nth"]
    plan = mix(docs, seed).select("doc_id", "size", "source", F.row_number().over(W.partitionBy("doc_id", "size", "source").orderBy("start")).alias("nth"), "copies")
    plan = plan.select(*(F.col(c).alias(f"p_{c}") for c in key), F.explode("copies").alias("c"))
    own = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.xxhash64(F.to_json(F.struct(*(docs[f"`{c}`"] for c in docs.columns if c != "text")))).alias("rest"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.col("source").cast("string").alias("source"))
    row = lambda c: F.col("row").getField(c)
    own = own.withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "size", "source").orderBy(F.xxhash64(row("text").cast("string")), "rest")))
    joined = own.join(plan, [F.col(c).eqNullSafe(F.col(f"p_{c}")) if c in ("doc_id", "source") else F.col(c) == F.col(f"p_{c}") for c in key])
    whole = (F.col("c.from") == 0) & (F.col("c.to") == F.col("size"))
    cut = F.array_join(F.slice(F.regexp_extract_all(row("text"), F.lit(WORD), F.lit(0)), F.col("c.from").cast("int") + 1, (F.col("c.to") - F.col("c.from")).cast("int")), " ")
    text = F.when(whole, row("text")).otherwise(cut)
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return joined.select(*(new.get(c, row(c)).alias(c) for c in docs.columns))
