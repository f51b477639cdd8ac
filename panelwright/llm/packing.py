"""Best-fit packing into sequences of several permitted lengths.

Items are documents' words, documents longer than the largest length being cut into pieces.  Items are
dealt by hash into shards of bounded size (equal rows are counted and each copy dealt by its own number),
each packed by itself: items in falling length go to the
open bin with least room left that holds them; where none does, the bin size of least expected cost a
word is opened; in the end each bin shrinks to the smallest permitted length that holds its contents.
All permitted opening policies are tried on each shard and the cheapest is kept.  `place` is where a
piece starts in its bin, so that a sequence can be laid out again.  A document without
words (or a null text) gets one row with no bin.  Repeated rows are packed as separate items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .mixing import WORD

CAPACITIES, OVERHEAD, SHARD_ITEMS = (256, 512, 1024, 2048, 4096), 16, 20_000
SCHEMA = "doc_id long, piece int, start long, length long, bin_id long, capacity long, place long"


def best_fit(lengths: list[int], capacities: tuple[int, ...], openings: tuple[int, ...], overhead: int) -> tuple[list[int], list[int]]:
    """(bin of each item, contents of each bin) for lengths in falling order; `openings` are the sizes to open."""
    room: dict[int, list[int]] = {}
    free = 0  # bit r is set when a bin with room r is open
    bins, used, size, fill, closed = [], [], [], 0.9, 1
    for n in lengths:
        fit = free >> n
        if fit:
            r = n + ((fit & -fit).bit_length() - 1)
            b = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
        else:
            may = [c for c in openings if c >= n] or [capacities[-1]]
            r = min(may, key=lambda c: ((c + overhead) / (n + (c - n) * fill), c))
            b = len(used)
            used.append(0)
            size.append(r)
        used[b] += n
        left = r - n
        if left:
            room.setdefault(left, []).append(b)
            free |= 1 << left
        else:
            closed += 1
            fill += (1.0 - fill) / closed
        bins.append(b)
    return bins, used


def cost(used: list[int], capacities: tuple[int, ...], overhead: int) -> int:
    ends = np.array(capacities)
    return int((ends[np.searchsorted(ends, used)] + overhead).sum()) if used else 0


def pack_shard(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int]]:
    """(bin of each item, final length of each bin): the cheapest of the opening policies."""
    ways = [best_fit(lengths, capacities, capacities[k:], overhead) for k in range(len(capacities))]
    bins, used = min(ways, key=lambda w: cost(w[1], capacities, overhead))
    ends = np.array(capacities)
    return bins, ends[np.searchsorted(ends, used)].tolist() if used else []


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, bin_id, capacity, place."""
    capacities = tuple(sorted(capacities))
    most = capacities[-1]
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n"))
    same = written(sized.groupBy("doc_id", "n").agg(F.count("*").alias("copies")), "sizes")
    pieces = F.greatest(F.ceil(F.col("n") / most), F.lit(1))
    shards = max(1, -(-(same.agg(F.sum(F.col("copies") * pieces)).first()[0] or 0) // shard_items))
    each = same.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    cut = each.select("doc_id", "n", "nth", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(most).cast("long"))).alias("piece", "start"))
    items = cut.select("doc_id", "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(most)).alias("length"), "nth")
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "length", "nth"), F.lit(shards))).repartition(shards, "shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "piece", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(shard: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            length = t.column("length").to_pylist()
            n = sum(x > 0 for x in length)
            bins, ends = pack_shard(length[:n], capacities, overhead)
            ids = [(shard << 32) + b for b in bins] + [None] * (len(length) - n)
            caps = [ends[b] for b in bins] + [None] * (len(length) - n)
            full, place = [0] * len(ends), []
            for b, x in zip(bins, length, strict=False):
                place.append(full[b])
                full[b] += x
            place += [None] * (len(length) - n)
            own = [pa.array(v, pa.int64()) for v in (ids, caps, place)]
            return pa.RecordBatch.from_arrays([*(t.column(c) for c in ("doc_id", "piece", "start", "length")), *own], ["doc_id", "piece", "start", "length", "bin_id", "capacity", "place"])

        held, now = [], None
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            for lo, hi in zip(b := [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1), len(shard)], b[1:], strict=False):
                if hi == lo:
                    continue
                if held and shard[lo] != now:
                    yield out(now, held)
                    held = []
                now = int(shard[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield out(now, held)

    return dealt.mapInArrow(run, SCHEMA)
