"""Substring dedup over words: suffix automata of reference shards give each document's matching statistics.

A window is `length` consecutive words.  Words covered by a window that also stands in a document of a
smaller doc_id are removed; windows are judged on the input.  A shard holds the stretches of words
around one minimizer (see `passages`): documents stream through the automaton of all earlier documents of
the shard, and places whose match is at least `length` words long end a repeated window.  Shards reach
their documents by a join on the minimizer instead of a broadcast of every shard to every document,
whose cost would grow with the square of the corpus; `against` takes a reference table and broadcasts its
automaton after checking its size.

Null texts have no words and nothing is removed; a null doc_id is neither reference nor changed.  Rows of
one doc_id don't remove each other's words.  A repeated row gets an equal result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import passages
from .common import per_piece

LENGTH, MAX_REFERENCE_WORDS = 13, 2_000_000
#: The words of a shard's minimizer, and of the longer ones that split a crowded shard.
GRAMS = (5, 8, 11)
#: At most so many stretches of some 120 bytes meet in one shard.
MOST = 4_000


class Automaton:
    """A suffix automaton of several sequences of words."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def add(self, words: list) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _extend(self, last: int, w) -> int:
        nxt, link, size = self.next, self.link, self.size
        if w in nxt[last]:
            q = nxt[last][w]
            return q if size[q] == size[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w, q: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def statistics(self, words: list) -> list[int]:
        """For each place, the length of the longest match that ends there."""
        nxt, link, size = self.next, self.link, self.size
        at, n, out = 0, 0, []
        for w in words:
            while at and w not in nxt[at]:
                at = link[at]
                n = size[at]
            to = nxt[at].get(w)
            if to is None:
                n = 0
            else:
                at, n = to, n + 1
            out.append(n)
        return out


def _match(batches: Iterator[pa.RecordBatch], search: passages.Search) -> Iterator[pa.RecordBatch]:
    """The repeated windows of each shard's documents, which come in the order of their ids."""
    length = search.length
    for batch in passages.groups(batches):
        h = batch.column("h").to_numpy()
        cuts = np.flatnonzero(h[1:] != h[:-1]) + 1
        ids, th, starts, n = (batch.column(c).to_pylist() for c in ("doc_id", "th", "starts", "n"))
        body = batch.column("body").to_pylist()
        out: list[tuple[int, int, int, int]] = []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(h)], strict=True):
            if ids[lo] == ids[hi - 1]:
                continue
            shard, first, fresh, told = None, {}, [], []
            for i in range(lo, hi):
                b, hits = body[i], []
                if fresh and ids[i] != ids[i - 1]:
                    told, fresh = told + fresh, []
                if (f := first.get(b)) is None:
                    first[b] = ids[i]
                    if told and shard is None:
                        shard = Automaton()
                    for t in told:
                        shard.add(t)
                    told = []
                    words = b.split(b" ")
                    fresh.append(words)
                elif f < ids[i]:
                    hits = [(0, n[i])]
                if shard is not None and not hits:
                    run = -1
                    for k, m in enumerate(shard.statistics(b.split(b" "))[length - 1 :]):
                        if m >= length:
                            run = k if run < 0 else run
                        elif run >= 0:
                            hits.append((run, k))
                            run = -1
                    if run >= 0:
                        hits.append((run, n[i]))
                out += [(ids[i], th[i], x + a, x + e) for a, e in hits for x in starts[i]]
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "th", "lo", "hi"])


NEW = ["n_words", "n_removed", "spans", "kept"]


def _cut(docs: DataFrame, length: int, grams: tuple[int, ...], most: int) -> DataFrame:
    """row (a struct of docs' columns but text), text, n_words, n_removed, spans (removed words, [from, to)) and kept (the rest, one space between)."""
    search = passages.Search(passages.words, length, grams, b" ", False, most)
    rows, ranges = passages.repeated(docs.select("doc_id", "text"), search, _match, True)
    own = passages.marked(docs, rows, ranges)
    schema = StructType([own.schema["row"], *StructType.fromDDL("text string, n_words long, n_removed long, spans array<struct<from:long,to:long>>, kept string").fields])

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for text, whole, spans in zip(piece.column("text").cast(pa.binary()).to_pylist(), piece.column("whole").to_pylist(), piece.column("spans").to_pylist(), strict=True):
            words = (text or b"").split()
            gone: list[dict] = []
            n = len(words)
            if whole and n >= length:
                words, gone = [], [{"from": 0, "to": n}]
            elif spans and not whole:
                mask = passages.covered([(s["lo"], s["hi"]) for s in spans], length, n)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                gone = [{"from": a, "to": b} for a, b in edge.reshape(-1, 2).tolist()]
                words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
            for o, v in zip(out, (n, n - len(words), gone, b" ".join(words).decode(errors="replace")), strict=True):
                o.append(v)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])), pa.string())
        return pa.RecordBatch.from_arrays([piece.column("row"), piece.column("text"), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], ["row", "text", *NEW])

    return per_piece(own, work, schema)


def _again(cut: DataFrame, docs: DataFrame, names: list[str], changed: dict[str, Column]) -> list[Column]:
    """The named columns of docs from what _cut() made of it, some of them changed."""
    same = {"text": F.col("text").cast(docs.schema["text"].dataType)} | changed
    return [same.get(c, F.col("row").getField(c)).alias(c) for c in names]


def dedup(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, most: int = MOST) -> DataFrame:
    """docs with n_words, n_removed, spans and kept; the columns of docs stay, those of these names are replaced."""
    cut = _cut(docs, length, grams, most)
    return cut.select(*_again(cut, docs, [c for c in docs.columns if c not in NEW], {}), *NEW)


def against(docs: DataFrame, reference: DataFrame, length: int = LENGTH, most_words: int = MAX_REFERENCE_WORDS) -> DataFrame:
    """doc_id and longest: the longest run of words of each text that stands in a reference text.

    The reference's automaton is broadcast; a reference of more than `most_words` words is refused.
    """
    spark = docs.sparkSession
    words = reference.select(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0] or 0
    if words > most_words:
        raise ValueError(f"the reference has {words} words; at most {most_words} are broadcast")
    shard = Automaton()
    for r in reference.select(F.col("text").cast("binary")).distinct().collect():
        shard.add((bytes(r[0]) if r[0] is not None else b"").split())
    sent = spark.sparkContext.broadcast(shard)

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        longest = [max(sent.value.statistics((t or b"").split()), default=0) for t in piece.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(longest, pa.int64()), pa.array([m >= length for m in longest])], ["doc_id", "longest", "found"])

    return per_piece(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), work, "doc_id long, longest long, found boolean")


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of docs, whatever their columns, with repeated passages taken out of their texts; untouched texts stay as they are."""
    cut = _cut(docs, length, GRAMS, MOST)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    new = {"text": text.cast(docs.schema["text"].dataType), "n_chars": F.coalesce(F.length(text), F.lit(0)).cast("long")}
    return cut.select(*_again(cut, docs, docs.columns, new))
