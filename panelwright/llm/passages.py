"""Where a run of units (words or bytes) of a fixed length stands more than once: candidates by minimizers.

A window is `length` consecutive units of one text.  Its minimizer, the least hash of its `gram`-unit runs,
depends on its content alone, so equal windows share it.  Consecutive windows of one minimizer form a
stretch; only stretches whose minimizer stands in several places travel, to the shard that their
minimizer names, where a matcher (a suffix automaton or a suffix array) decides.

A shard holds at most `most` stretches.  Those of a minimizer that has more are first collapsed: equal
stretches become one row with their number and first place, by an aggregate with partial sums.  Where more
than `most` different ones are left, they are cut again by a longer minimizer, which names smaller shards,
and so on up to minimizers as long as a window, whose shards hold one stretch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, pieces, settled, written
from .tokens import hashes, inner, mix, spans, texts

BLOCK_UNITS = 1 << 19

#: (units, hash of each unit, first unit of each text, byte where each unit starts and ends)
Units = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words(column) -> tuple[np.ndarray, Units]:
    data, off, _ = texts(column)
    start, end, first = spans(data, off)
    return data, (hashes(data, start, end), first, start, end)


def single_bytes(column) -> tuple[np.ndarray, Units]:
    data, off, _ = texts(column)
    at = np.arange(len(data))
    return data, (_BYTE[data], off, at, at + 1)


def run_hashes(units: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` units, a polynomial in them by doubling.

    Equal runs have equal hashes; where different ones do, only more is compared.
    """
    n = len(units) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, width, done, out = units, 1, 0, None
    factor, rest = 0xD1342543DE82EF95, size
    while rest:
        shift = np.uint64(factor)
        if rest & 1:
            part = power[done : done + n]
            out = part.copy() if out is None else out * shift + part
            done += width
        rest >>= 1
        if rest:
            power = power[: len(power) - width] * shift + power[width:]
            width, factor = 2 * width, factor * factor % 2**64
    return mix(out)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    width = 1
    n = len(x) - size + 1
    while 2 * width <= size:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    return np.minimum(x[:n], x[size - width : size - width + n])


def stretches(units: np.ndarray, first: np.ndarray, length: int, gram: int, twins: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first window, number of windows, minimizer, whether the minimizer stands twice within), block by block."""
    wide = length - gram + 1
    within = inner(first, length)
    for lo in range(0, max(0, len(units) - length + 1), BLOCK_UNITS):
        part = units[lo : lo + BLOCK_UNITS + length - 1]
        g = run_hashes(part, gram)
        m = sliding_min(g, wide)
        ok = within[lo : lo + len(m)]
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | ~ok[:-1]
        head = np.flatnonzero(new & ok)
        if not len(head):
            continue
        end = np.append(np.flatnonzero((new | ~ok)[1:]) + 1, len(m))
        n = end[np.searchsorted(end, head, side="right")] - head
        cuts = -(-n // wide)  # long stretches of one minimizer are cut
        at = np.repeat(head, cuts) + wide * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
        n = np.minimum(wide, np.repeat(head + n, cuts) - at)
        if twins:
            size = n + wide - 1
            base = np.cumsum(size) - size
            pos = np.repeat(at - base, size) + np.arange(size.sum())
            twin = np.add.reduceat(g[pos] == np.repeat(m[at], size), base) > 1
        else:
            twin = np.zeros(len(at), bool)
        yield at + lo, n, m[at], twin


class Search:
    """One kind of units with its window length, the lengths of its minimizers and the most stretches of a shard."""

    def __init__(self, units: Callable, length: int, grams: tuple[int, ...], join: bytes, twins: bool, most: int):
        self.units, self.length, self.grams, self.join, self.twins, self.most = units, length, (*grams, length), join, twins, most

    def bodies(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The units that the windows at..at+n-1 cover."""
        last = (at + n + self.length - 2).tolist()
        if self.join:
            return [self.join.join([data[lo[j] : hi[j]].tobytes() for j in range(x, y + 1)]) for x, y in zip(at.tolist(), last, strict=True)]
        raw = data.tobytes()
        return [raw[x : y + 1] for x, y in zip(at.tolist(), last, strict=True)]

    def minimizers(self, docs: DataFrame) -> DataFrame:
        """(h, doc_id, n): each text's minimizers and how many stretches, or places within one, each has in it."""
        me = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches, limit=1 << 20):
                _, (units, first, _, _) = me.units(piece.column("text"))
                ids = piece.column("doc_id").to_numpy()
                for at, _, m, twin in stretches(units, first, me.length, me.grams[0], me.twins):
                    of = np.searchsorted(first, at, side="right") - 1
                    order = np.lexsort((m, of))
                    m, of, twin = m[order], of[order], twin[order]
                    head = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (of[1:] != of[:-1])]))
                    n = np.diff(np.append(head, len(m))) + np.add.reduceat(twin.astype(int), head)
                    yield pa.RecordBatch.from_arrays([pa.array(m[head].view(np.int64)), pa.array(ids[of[head]]), pa.array(n.astype(np.int32))], ["h", "doc_id", "n"])

        return docs.mapInArrow(run, "h long, doc_id long, n int")

    def travelling(self, docs: DataFrame, lists: DataFrame) -> DataFrame:
        """The stretches of docs whose minimizers are listed, by (doc_id, few, many): `crowded` ones are in `many`."""
        me = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches, limit=1 << 20):
                data, (units, first, lo, hi) = me.units(piece.column("text"))
                ids, th = (piece.column(c).to_numpy() for c in ("doc_id", "th"))
                salt = np.arange(1, len(ids) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                key = []
                for c in ("few", "many"):
                    col = piece.column(c)
                    owner = np.repeat(np.arange(len(ids)), np.asarray(col.value_lengths().to_numpy(zero_copy_only=False)).astype(int))
                    key.append(mix(np.asarray(col.flatten().to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64) ^ salt[owner]))
                for at, n, m, _ in stretches(units, first, me.length, me.grams[0], False):
                    of = np.searchsorted(first, at, side="right") - 1
                    mine = mix(m ^ salt[of])
                    crowded = np.isin(mine, key[1])
                    go = np.flatnonzero(crowded | np.isin(mine, key[0]))
                    if len(go):
                        a, o = at[go], of[go]
                        arrays = (pa.array(crowded[go]), pa.array(m[go].view(np.int64)), pa.array(ids[o]), pa.array(th[o]), pa.array(a - first[o]), pa.array(n[go].astype(np.int64)), pa.array(me.bodies(data, lo, hi, a, n[go]), pa.binary()))
                        yield pa.RecordBatch.from_arrays(list(arrays), ["crowded", "h", "doc_id", "th", "start", "n", "body"])

        return docs.join(lists, ["doc_id", "th"]).mapInArrow(run, "crowded boolean, h long, doc_id long, th long, start long, n long, body binary")

    def cut_again(self, rows: DataFrame, gram: int) -> DataFrame:
        """The stretches of rows cut by their minimizers of `gram` units; h names the old and the new minimizer."""
        me = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, (units, first, lo, hi) = me.units(batch.column("body"))
                h = batch.column("h").to_numpy().view(np.uint64)
                starts, w = batch.column("starts").to_pylist(), batch.column("w").to_numpy()
                ids, th = (batch.column(c).to_numpy() for c in ("doc_id", "th"))
                for at, n, m, _ in stretches(units, first, me.length, gram, False):
                    of = np.searchsorted(first, at, side="right") - 1
                    off = (at - first[of]).tolist()
                    moved = [[x + k for x in starts[o]] for o, k in zip(of.tolist(), off, strict=True)]
                    arrays = (pa.array(mix(m ^ mix(h[of])).view(np.int64)), pa.array(ids[of]), pa.array(th[of]), pa.array(moved, pa.list_(pa.int64())), pa.array(n.astype(np.int64)), pa.array(me.bodies(data, lo, hi, at, n), pa.binary()), pa.array(w[of]))
                    yield pa.RecordBatch.from_arrays(list(arrays), SHARD)

        return rows.select(*SHARD).mapInArrow(run, "h long, doc_id long, th long, starts array<long>, n long, body binary, w long")


#: The columns of a shard's rows: a stretch that stands at `starts` of one text and at `w` places in all.
SHARD = ["h", "doc_id", "th", "starts", "n", "body", "w"]


def bounded(crowded: DataFrame, search: Search, earlier: bool) -> tuple[list[DataFrame], list[DataFrame]]:
    """(shards, ranges) of the stretches of crowded minimizers: collapsed and cut again until no shard has more than `most`.

    ranges are those of stretches that, as a whole, stand elsewhere (with `earlier`: in a text of a smaller doc_id).
    """
    shards: list[DataFrame] = []
    ranges: list[DataFrame] = []
    rows = crowded
    for gram in [*search.grams[1:], None]:
        printed = rows.withColumn("p", F.unhex(F.md5("body")))
        own = printed.groupBy("h", "p", "doc_id", "th").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.sum("w").alias("w"), F.min("n").alias("n"), F.min("body").alias("body"))
        own = written(own, "own")
        one = own.groupBy("h", "p").agg(F.min(F.struct("doc_id", "th", "starts")).alias("r"), F.sum("w").alias("w"), F.min("n").alias("n"), F.min("body").alias("body"))
        one = written(one.select("h", "p", "r.doc_id", "r.th", "r.starts", "n", "body", "w"), "one")
        known = one.select("h", "p", F.col("doc_id").alias("first"), F.col("w").alias("all"))
        again = own.select("h", "p", "doc_id", "th", "starts", "n").join(known, ["h", "p"]).where("doc_id > first" if earlier else "all > 1")
        ranges.append(again.select("doc_id", "th", F.explode("starts").alias("lo"), "n").select("doc_id", "th", "lo", (F.col("lo") + F.col("n")).alias("hi")))
        busy = written(one.groupBy("h").count().where(F.col("count") > search.most).select("h"), "busy")
        if gram is None or busy.isEmpty():
            shards.append(one.select(*SHARD))
            break
        shards.append(one.join(busy, "h", "left_anti").select(*SHARD))
        rows = search.cut_again(one.join(busy, "h", "left_semi"), gram)
    return shards, ranges


def repeated(docs: DataFrame, search: Search, matcher: Callable, earlier: bool) -> tuple[DataFrame, DataFrame]:
    """(rows, ranges) of the windows of docs (doc_id, text) that stand elsewhere.

    rows: doc_id, th (hash of the text) and whole: the text is a copy all of whose windows are repeated.
    ranges: doc_id, th, lo, hi: windows lo to hi - 1 are repeated.  With `earlier`, only those that also
    stand in a text of a smaller doc_id; otherwise those that stand at any other place.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    hashed = docs.select("doc_id", F.xxhash64("text").alias("th"), F.md5(F.col("text").cast("binary")).alias("sum"), F.octet_length("text").alias("size"))

    def copied() -> DataFrame:
        rows = written(hashed.where(F.col("size") >= search.length), "rows")
        # Written, so that the join may split a large group of copies.
        copies = written(rows.groupBy("sum", "size").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "copies")
        first = F.coalesce("first", "doc_id")
        whole = (F.col("doc_id") > first) if earlier else F.col("copies").isNotNull()
        return rows.join(copies, ["sum", "size"], "left").select("doc_id", "th", whole.alias("whole"), (F.col("doc_id") == first).alias("head"))

    known = settled(copied, "known")
    found = settled(lambda: _found(docs, known, search, matcher, earlier), "ranges")
    return known.select("doc_id", "th", "whole").groupBy("doc_id", "th").agg(F.max("whole").alias("whole")), found


def _found(docs: DataFrame, known: DataFrame, search: Search, matcher: Callable, earlier: bool) -> DataFrame:
    """doc_id, th, lo, hi: the repeated windows of the first copies of known (doc_id, th, head)."""
    places = written(search.minimizers(docs), "minimizers")
    several = places.groupBy("h").agg(F.count("*").alias("texts"), F.sum("n").alias("n")).where("texts > 1" if earlier else "n > 1").select("h", (F.col("n") > search.most).alias("busy"))
    lists = places.join(several, "h").groupBy("doc_id").agg(F.collect_set(F.when(~F.col("busy"), F.col("h"))).alias("few"), F.collect_set(F.when(F.col("busy"), F.col("h"))).alias("many"))
    lists = lists.join(known.where("head").select("doc_id", "th").distinct(), "doc_id")
    heads = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    moved = written(search.travelling(heads, lists), "stretches")
    drop(places)
    single = moved.select("crowded", "h", "doc_id", "th", F.array("start").alias("starts"), "n", "body", F.lit(1).cast("long").alias("w"))
    shards, ranges = [single.where("not crowded").select(*SHARD)], []
    crowded = single.where("crowded").select(*SHARD)
    if not crowded.isEmpty():
        more, ranges = bounded(crowded, search, earlier)
        shards += more
    near = shards[0]
    for other in shards[1:]:
        near = near.union(other)
    near = near.repartition("h").sortWithinPartitions("h", "doc_id", "th")
    found = near.mapInArrow(lambda batches: matcher(batches, search), "doc_id long, th long, lo long, hi long")
    for other in ranges:
        found = found.union(other)
    return found


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that never cut a minimizer's rows apart, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        h = batch.column("h").to_numpy()
        if not len(h):
            continue
        if held and held[-1].column("h")[held[-1].num_rows - 1].as_py() != h[0]:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
        cut = int(np.searchsorted(h, h[-1])) if len(h) else 0
        if cut:
            yield from pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def covered(ranges: list[tuple[int, int]], length: int, n: int) -> np.ndarray:
    """Which of n units lie in a window of the ranges."""
    step = np.zeros(n + 1, np.int64)
    for lo, hi in ranges:
        step[min(lo, n)] += 1
        step[min(hi - 1 + length, n)] -= 1
    return np.cumsum(step)[:n] > 0


def marked(docs: DataFrame, rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """row (a struct of docs' columns but text), text, whole and spans (its ranges; both null where there is none)."""
    gathered = ranges.groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    info = rows.join(gathered, ["doc_id", "th"], "left").where("whole or spans is not null").select(F.col("doc_id").alias("id"), "th", "whole", "spans")
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns if c != "text"))
    keyed = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("own_id")).withColumn("own_th", F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.join(info, (F.col("own_id") == F.col("id")) & (F.col("own_th") == F.col("th")), "left").select("row", "text", "whole", "spans")
