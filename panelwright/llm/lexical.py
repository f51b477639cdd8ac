"""Ranked lexical search: a K2-treap over each shard's grid of terms and documents, descended best-first.

`build` writes the index: a row for each shard of documents, with its terms, its documents and, term by
term, the documents that hold it and how often.  `search` makes each shard a K2-treap: a quadtree over
(term, document) whose nodes say which quarters hold anything (four bits and the first child's place) and
the highest impact of a cell below.  A query follows the paths of all its terms' rows together down to
document ranges: the sum of its terms' weights times their nodes' maxima bounds every score of a range, and
the ranges of highest bound are opened first, in small batches, until none can enter the `k` best.

- A term is a maximal run of ASCII digits, letters and characters beyond ASCII, A-Z lower-cased; terms are
  known by 64-bit hashes.  Weights and impacts are the integers that `weight` and `impact` give.
- Null texts and texts without terms are no documents.  Rows that repeat a doc_id are documents of their own;
  those without doc_id come last among equal scores.  Equal scores go by ascending doc_id.
- Rows that repeat an item_id are one item with the terms of all of them; items without terms have no rows.
- An empty table on either side gives an empty result; further columns are not looked at.

A shard is bounded in bytes of text (`SHARD_BYTES`, or one longer text).  The queries' terms are sent to all
tasks in blocks of about `MOST_TERMS`; a task keeps `k` documents of each item over all its shards.  A few
shards are searched first: what is below their k-th score can't be among the k best, so that the other tasks
leave it unopened and unsaid.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import per_piece, pieces, written
from .tokens import LOWER, hashes, spans, texts

K, SHARD_BYTES, MOST_TERMS, BATCH, CELLS = 50, 16 << 20, 1_000_000, 128, 1 << 19
#: Shards that are searched first for a floor of each item's scores: a SEED_PART-th of all, at most SEEDS.
SEEDS, SEED_PART = 64, 16
NO_ID = np.iinfo(np.int64).max

GAP = np.ones(256, bool)
GAP[48:58] = GAP[65:91] = GAP[97:123] = GAP[128:] = False


def weight(df: int, n_docs: int) -> int:
    """A term's weight from the number of documents that hold it."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one unit of a term's weight adds to the score of a document of n terms that holds it tf times."""
    m = 100 - 50 + (50 * n * n_docs) // max(1, n_terms)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _terms(column) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term in order, first term of each text)."""
    data, off, _ = texts(column)
    data = LOWER[data]
    start, end, first = spans(data, off, GAP)
    return hashes(data, start, end), first


def _packed(x: np.ndarray) -> bytes:
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}" if n else "u1").astype(np.int64)


class _Shard:
    """Documents and their terms, until they are written as one row."""

    def __init__(self) -> None:
        self.ids, self.n, self.terms, self.cells, self.size = [], [], [], [], 0

    def add(self, ids: np.ndarray, column) -> None:
        h, first = _terms(column)
        n = np.diff(first)
        some = np.flatnonzero(n)
        u, term = np.unique(h, return_inverse=True)
        doc = np.repeat(np.arange(len(some)), n[some]) + sum(map(len, self.ids))
        cell, tf = np.unique(doc * max(1, len(u)) + term, return_counts=True)
        self.ids.append(ids[some])
        self.n.append(n[some])
        self.terms.append(u)
        self.cells.append((cell // max(1, len(u)), cell % max(1, len(u)), tf))

    def row(self) -> pa.RecordBatch | None:
        """Terms by falling number of documents, documents by id, cells by term and then document."""
        ids, n = np.concatenate(self.ids), np.concatenate(self.n)
        if not len(ids):
            return None
        terms = np.unique(np.concatenate(self.terms))
        doc, tf = (np.concatenate([c[k] for c in self.cells]) for k in (0, 2))
        term = np.concatenate([np.searchsorted(terms, u)[c[1]] for u, c in zip(self.terms, self.cells, strict=True)])
        by_id = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[by_id] = np.arange(len(ids))
        df = np.bincount(term, minlength=len(terms))
        by_df = np.argsort(-df, kind="stable")
        row = np.empty(len(terms), np.int64)
        row[by_df] = np.arange(len(terms))
        order = np.argsort(row[term] * len(ids) + place[doc])
        cols = [terms[by_df].tobytes(), _packed(df[by_df]), ids[by_id].tobytes(), _packed(n[by_id]), _packed(place[doc][order]), _packed(tf[order])]
        return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([len(terms)], pa.int64()), pa.array([len(doc)], pa.int64()), *(pa.array([c], pa.binary()) for c in cols)], INDEX)


INDEX = ["n_docs", "n_terms", "n_rows", "n_cells", "terms", "df", "ids", "sizes", "doc", "tf"]


def build(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all rows of docs (doc_id, text), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for piece in pieces(batches):
            ids = piece.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            column = piece.column("text")
            shard.add(ids, column)
            shard.size += column.nbytes
            if shard.size >= shard_bytes:
                if (row := shard.row()) is not None:
                    yield row
                shard = _Shard()
        if shard.ids and (row := shard.row()) is not None:
            yield row

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, ", ".join(f"{c} long" for c in INDEX[:4]) + ", " + ", ".join(f"{c} binary" for c in INDEX[4:])), "lexical")


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of x with a free bit before each."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x


#: For the four bits of a node and one of its quarters: which child that is, or -1.
CHILD = np.array([[bin(bits & ((1 << q) - 1)).count("1") if bits >> q & 1 else -1 for q in range(4)] for bits in range(16)], np.int64)


class Treap:
    """A grid's non-empty cells (row, column, impact) as a quadtree of impact maxima; a node's children are neighbours.

    Nodes of all levels share three arrays; the last entry stands for an empty node.
    """

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray) -> None:
        self.height = max(int(row.max(initial=0)), int(col.max(initial=0)), 1).bit_length()
        code = (_spread(row) << np.uint64(1)) | _spread(col)
        order = np.argsort(code)
        code, peak = code[order], value[order]
        peaks, bits, first, base = [peak], [np.zeros(len(peak), np.uint8)], [np.zeros(len(peak), np.int64)], 0
        for _ in range(self.height):
            up = code >> np.uint64(2)
            head = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
            peaks.append(np.maximum.reduceat(peaks[-1], head))
            bits.append(np.bitwise_or.reduceat((1 << (code & np.uint64(3)).astype(np.int64)).astype(np.uint8), head))
            first.append(head + base)
            base, code = base + len(code), up[head]
        self.root = base
        self.peak = np.append(np.concatenate(peaks), 0)
        self.bits = np.append(np.concatenate(bits), 0)
        self.first = np.append(np.concatenate(first), 0)
        self.empty = len(self.peak) - 1

    def children(self, node: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        at = CHILD[self.bits[node], quarter]
        return np.where(at < 0, self.empty, self.first[node] + at)

    def best(self, rows: np.ndarray, weights: np.ndarray, ids: np.ndarray, k: int, top: tuple[np.ndarray, np.ndarray], floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The k best of `top` (scores, ids) and all columns of at least `floor`, a column's score being the sum of its weighted cells in `rows`."""
        scores, owners = top
        level, place = np.array([self.height]), np.array([0])
        node = np.full((1, len(rows)), self.root)
        bound = (self.peak[node] * weights).sum(1)
        batch = max(1, min(BATCH, CELLS // max(1, len(rows))))
        while len(bound):
            if len(scores) == k:
                last = scores[-1]
                # Equal bounds may still hold a smaller id.
                go = (bound > last) | ((bound == last) & (ids[np.minimum(place << level, len(ids) - 1)] < owners[-1]))
                if not go.all():
                    level, place, node, bound = level[go], place[go], node[go], bound[go]
                    if not len(bound):
                        break
            if len(bound) > batch:
                take = np.argpartition(-bound, batch)
                take, rest = take[:batch], take[batch:]
            else:
                take, rest = np.arange(len(bound)), np.zeros(0, np.int64)
            lev = level[take] - 1
            half = (rows[None] >> lev[:, None]) & 1
            both = [(lev, 2 * place[take] + h, self.children(node[take], 2 * half + h)) for h in (0, 1)]
            lev, at, child = (np.concatenate([b[i] for b in both]) for i in range(3))
            most = (self.peak[child] * weights).sum(1)
            some = most >= floor
            lev, at, child, most = lev[some], at[some], child[some], most[some]
            done = lev == 0
            if done.any():
                s, o = np.concatenate([scores, most[done]]), np.concatenate([owners, ids[at[done]]])
                order = np.lexsort((o, -s))[:k]
                scores, owners = s[order], o[order]
            level, place, node, bound = (np.concatenate([old[rest], new[~done]]) for old, new in ((level, lev), (place, at), (node, child), (bound, most)))
        return scores, owners


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct term hashes of each item."""

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        h, first = _terms(piece.column("text"))
        owner = pa.array(np.repeat(np.arange(len(first) - 1), np.diff(first)))
        return pa.RecordBatch.from_arrays([piece.column("item_id").take(owner), pa.array(h.view(np.int64))], ["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return per_piece(rows, work, "item_id long, term long").distinct()


def document_frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How many documents hold each of the terms (ascending hashes); as many numbers as terms reach the driver."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for n, own, df in zip(*(batch.column(c).to_pylist() for c in ("n_rows", "terms", "df")), strict=True):
                have, df = np.frombuffer(own, np.uint64), _unpacked(df, n)
                at = np.minimum(np.searchsorted(shared.value, have), len(shared.value) - 1)
                hit = shared.value[at] == have
                total[at[hit]] += df[hit]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["i", "df"])

    found = index.select("n_rows", "terms", "df").mapInArrow(run, "i long, df long").groupBy("i").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(len(terms), np.int64)
    out[found["i"].to_numpy()] = found["df"].to_numpy()
    return out


def _search(index: DataFrame, queries: list[tuple[int | None, np.ndarray, np.ndarray, int]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): each task's k best documents of each query (item_id, terms, weights, least score)."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                n_own, n_rows, n_cells = (batch.column(c)[i].as_py() for c in ("n_docs", "n_rows", "n_cells"))
                terms, df, ids, sizes, doc, tf = (batch.column(c)[i].as_py() for c in INDEX[4:])
                terms, ids, doc = np.frombuffer(terms, np.uint64), np.frombuffer(ids, np.int64), _unpacked(doc, n_cells)
                value = impact(_unpacked(tf, n_cells), _unpacked(sizes, n_own)[doc], n_docs, n_terms)
                grid = Treap(np.repeat(np.arange(n_rows), _unpacked(df, n_rows)), doc, value)
                by_hash = np.argsort(terms)
                known = terms[by_hash]
                for q, (_, own, weights, floor) in enumerate(shared.value):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    hit = known[at] == own
                    if hit.any():
                        top[q] = grid.best(by_hash[at[hit]], weights[hit], ids, k, top[q], floor)
        for (item, *_), (scores, owners) in zip(shared.value, top, strict=True):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(scores), pa.int64()), pa.array(owners, mask=owners == NO_ID), pa.array(scores)], ["item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, k: int = K, most_terms: int = MOST_TERMS, seed_part: int = SEED_PART) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents of each item with a score above 0."""
    n_docs, n_terms, shards = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0)), F.count("*")).first()
    asked = written(item_terms(items), "terms")
    blocks = max(1, -(-asked.count() // most_terms))
    seeds = index.where(F.pmod(F.xxhash64("ids"), F.lit(max(1, shards))) < min(SEEDS, shards // seed_part))
    found = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toPandas()
        rows["item_id"] = rows["item_id"].astype("Int64")
        terms, at = np.unique(rows["term"].to_numpy().view(np.uint64), return_inverse=True)
        df = document_frequencies(index, terms) if len(terms) else np.zeros(0, np.int64)
        weights = np.array([weight(int(x), n_docs) if x else 0 for x in df], np.int64)
        queries = []
        for item, own in rows.assign(at=at).groupby("item_id", dropna=False)["at"]:
            own = np.sort(own.to_numpy())
            own = own[weights[own] > 0]
            if len(own):
                queries.append((None if pd.isna(item) else int(item), terms[own], weights[own], 1))
        if shards >= seed_part:
            floors = {r.item_id: r.score for r in _ranked(_search(seeds, queries, n_docs, n_terms, k), k).where(F.col("rank") == k).select("item_id", "score").collect()}  # one row for each item of the block
            queries = [(*q[:3], floors.get(q[0], 1)) for q in queries]
        part = _search(index, queries, n_docs, n_terms, k)
        found = part if found is None else found.union(part)
    return _ranked(found, k).select("item_id", "rank", "doc_id", "score")
