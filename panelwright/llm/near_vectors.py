"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are turned by one fixed random rotation and split into blocks of `BLOCK_DIMS` dimensions.
Two vectors of cosine c are 2 - 2c apart (squared), so in at least one of m blocks they are at most
(2 - 2c) / m apart: each block is range-joined under that budget and the union of the candidates is
verified exactly, in double precision, on the original vectors.

The range join of a block puts vectors into grid cells over the block's first two coordinates, as wide
as the budget's radius, so that partners lie in adjacent cells.  A cell's vectors are cut into chunks
of bounded size, and pairs of chunks, not vectors, are joined by key and compared in one matrix product,
so a crowded cell spreads over as many tasks as it has pairs of chunks.  Equal vectors are collapsed
first; their copies are linked by count.  Null, zero or non-finite vectors link with nothing, and
vectors of different length do not link.  Rows that repeat a vec_id count as one vector if they are equal
and are otherwise all linked under that id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, per_piece, written

COSINE, BLOCK_DIMS, CHUNK, SEED, SLACK = 0.95, 16, 1024, 3, 1e-6


@lru_cache(maxsize=16)
def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def _scaled(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The vectors laid end to end in `flat`, each with its largest component brought between 0.5 and 1."""
    top = np.frexp(np.maximum.reduceat(np.abs(flat), start))[1]
    return np.ldexp(flat, -np.repeat(top, size))


def _blocks(vectors: DataFrame, cosine: float, block_dims: int) -> DataFrame:
    """(id, dims, block, x, y, sub): the cell and the rotated part of each vector in each block."""

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        col, ids = piece.column("v"), piece.column("id").to_numpy()
        flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), float)
        size = np.asarray(col.value_lengths().to_numpy(zero_copy_only=False))
        off = np.cumsum(size) - size
        rows: dict[str, list] = {k: [] for k in ("id", "dims", "block", "x", "y", "sub")}
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            u = _scaled(flat[off[at][:, None] + np.arange(d)].ravel(), np.arange(len(at)) * d, np.full(len(at), d)).reshape(-1, d)
            u = u / np.linalg.norm(u, axis=1, keepdims=True) @ rotation(int(d))
            m = max(1, int(d) // block_dims)
            wide = max(np.sqrt((2 - 2 * cosine) / m) + SLACK, 1e-3)
            for b, part in enumerate(np.array_split(u, m, axis=1)):
                rows["id"].append(ids[at])
                rows["dims"].append(np.full(len(at), d))
                rows["block"].append(np.full(len(at), b))
                rows["x"].append(np.floor(part[:, 0] / wide).astype(int))
                rows["y"].append(np.floor(part[:, min(1, part.shape[1] - 1)] / wide).astype(int))
                rows["sub"] += [r.tobytes() for r in part.astype(np.float32)]
        arrays = [pa.array(np.concatenate(rows[k]).astype(np.int64)) for k in ("id", "dims", "block", "x", "y")]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(rows["sub"], pa.binary())], list(rows))

    return per_piece(vectors, work, "id long, dims long, block long, x long, y long, sub binary", "v")


def candidates(vectors: DataFrame, cosine: float = COSINE, block_dims: int = BLOCK_DIMS, chunk: int = CHUNK) -> DataFrame:
    """Distinct (a, b), a < b: the ids within budget of each other in some block; `vectors` has id and v."""
    cell = ["dims", "block", "x", "y"]
    parts = _blocks(vectors, cosine, block_dims)
    n_chunks = parts.groupBy(*cell).count().select(*cell, F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    chunks = parts.join(n_chunks, cell).withColumn("c", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    chunks = chunks.repartition(*cell, "c").groupBy(*cell, "c").agg(F.collect_list(F.struct("id", "sub")).alias("rows"))
    near = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i as dx, j as dy))))"))
    half = chunks.select("*", near.alias("d")).where("d.dx > 0 or (d.dx = 0 and d.dy >= 0)")
    asks = half.withColumn("x2", F.col("x") + F.col("d.dx")).withColumn("y2", F.col("y") + F.col("d.dy"))
    other = n_chunks.select("dims", "block", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("chunks").alias("n2"))
    asks = asks.join(other, ["dims", "block", "x2", "y2"]).withColumn("c2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)))
    asks = asks.where("d.dx <> 0 or d.dy <> 0 or c2 >= c").select("dims", "block", "x2", "y2", "c2", F.col("rows").alias("left"), (F.expr("d.dx = 0 and d.dy = 0") & (F.col("c") == F.col("c2"))).alias("same"))
    right = chunks.select("dims", "block", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("c").alias("c2"), F.col("rows").alias("right"))
    pairs = asks.join(right, ["dims", "block", "x2", "y2", "c2"]).select("dims", "same", "left", "right")

    def matrix(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, sub = rows.flatten().flatten()
        raw = np.frombuffer(b"".join(sub.to_pylist()), np.float32)
        return ids.to_numpy(), raw.reshape(len(ids), -1).astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                m = max(1, batch.column("dims")[i].as_py() // block_dims)
                budget = (2 - 2 * cosine) / m + SLACK
                (ia, a), (ib, b) = (matrix(batch.column(c).slice(i, 1)) for c in ("left", "right"))
                far = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
                p, q = np.nonzero(far <= budget)
                lo, hi = ia[p], ib[q]
                keep = lo < hi if batch.column("same")[i].as_py() else lo != hi
                lo, hi = lo[keep], hi[keep]
                if len(lo):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(lo, hi)), pa.array(np.maximum(lo, hi))], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long").distinct()


def links(table: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """(groups, pairs): vec_id with its class id (the smallest id of equal vectors) and n equal ones; verified pairs of classes."""
    given = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null")
    sound = given.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)).distinct()
    sound = sound.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 and 0.0 are one
    classes = sound.groupBy("v").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("n"))
    classes = written(classes, "classes")
    member = sound.join(classes, "v").select("vec_id", "id")
    found = candidates(classes.select("id", "v"), cosine)
    a, b = (classes.select(F.col("id").alias(k), F.col("v").alias(f"v{k}")) for k in "ab")
    full = found.join(a, "a").join(b, "b")

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        va, vb = (piece.column(c) for c in ("va", "vb"))
        size = np.asarray(va.value_lengths().to_numpy(zero_copy_only=False))
        start = np.cumsum(size) - size
        # Each vector is scaled by a power of two, which changes no digit of its cosine and keeps its squares from overflow and underflow.
        fa, fb = (_scaled(np.asarray(v.flatten().to_numpy(zero_copy_only=False), float), start, size) for v in (va, vb))
        dot, aa, bb = (np.add.reduceat(x, start) for x in (fa * fb, fa * fa, fb * fb))
        ok = dot / (np.sqrt(aa) * np.sqrt(bb)) >= cosine
        return pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b")], ["a", "b"]).filter(pa.array(ok))

    return classes.select("id", "n").join(member, "id"), per_piece(full.select("a", "b", "va", "vb"), work, "a long, b long", "va")


def near_duplicates(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row for each row of the table."""
    member, pairs = links(table, cosine)
    member, pairs = written(member, "members"), written(pairs, "pairs")
    size = member.select("id", "n").distinct()
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    outside = both.join(size.select(F.col("id").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("more"))
    roots = components(pairs)
    found = member.join(outside, member.id == outside.a, "left").join(roots, member.id == roots.node, "left")
    found = found.groupBy("vec_id").agg(F.max(F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.min(F.coalesce("root", "id")).alias("root"))
    every = table.select(F.col("vec_id").cast("long").alias("vec_id"))
    out = every.join(found, "vec_id", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
