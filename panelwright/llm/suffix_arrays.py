"""Suffix-array dedup over bytes: repeated strings of a fixed length, by induced sorting of shards.

A window is `length` consecutive bytes of one text.  Bytes covered by a window that also starts at any
other place, in the same text or another, are removed; windows are judged on the input and never cross
texts.  A shard holds stretches of bytes around one minimizer (see `passages`) and is sorted by
induction: suffixes are classed as smaller or larger than their successor, the leftmost-smaller
substrings are sorted and named, recursively where names repeat, and the rest is induced from them.
Common prefixes are then taken in text order, against each suffix's predecessor in the sorted order.

Null texts are empty.  A null doc_id is left as it is.  Rows that repeat a whole text of at least
`length` bytes are removed altogether, the first included, since each stands at another place too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passages
from .common import per_piece
from .tokens import mix

LENGTH, SHARD_BYTES, WIDE_ALPHABET = 200, 1 << 19, 1024
#: The bytes of a shard's minimizer, and of the longer ones that split a crowded shard.
GRAMS = (64, 120, 170)
#: At most so many stretches of some 280 bytes meet in one shard.
MOST = 500


def _smaller(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successor; the last one counts as smaller."""
    step = np.sign(np.append(t[1:], t[-1] + 1) - t)
    at = np.where(step != 0, np.arange(len(t)), len(t) - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def _induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes induced from the leftmost-smaller ones in `seeds`' order, bucket by bucket."""
    chars = np.unique(t)
    seeded = dict(zip(*_split(seeds, t[seeds]), strict=True))
    none = np.zeros(0, np.int64)
    larger: dict[int, np.ndarray] = {}
    coming: dict[int, list[np.ndarray]] = {}
    for c in chars.tolist():
        front = np.concatenate(coming.pop(c, [none]))
        parts, out = [], []
        while len(front):
            parts.append(front)
            j = front - 1
            j = j[(j >= 0) & ~small[j]]
            same = t[j] == c
            out.append(j[~same])
            front = j[same]
        larger[c] = np.concatenate(parts) if parts else none
        j = seeded.get(c, none) - 1
        out.append(j[(j >= 0) & ~small[j]])
        for d, part in zip(*_split(all_out := np.concatenate(out), t[all_out]), strict=True):
            coming.setdefault(d, []).append(part)
    done: list[np.ndarray] = []
    coming = {}
    for c in chars.tolist()[::-1]:
        front = np.concatenate(coming.pop(c, [none]))
        parts, out = [], []
        while len(front):
            parts.append(front)
            j = front - 1
            j = j[(j >= 0) & small[j]]
            same = t[j] == c
            out.append(j[~same])
            front = j[same]
        j = larger[c][::-1] - 1
        out.append(j[(j >= 0) & small[j]])
        for d, part in zip(*_split(all_out := np.concatenate(out), t[all_out]), strict=True):
            coming.setdefault(d, []).append(part)
        done += [*parts, larger[c][::-1]]
    return np.concatenate([*done, [len(t) - 1]])[::-1]


def _split(values: np.ndarray, keys: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The distinct keys and, for each, its values in their order."""
    if not len(values):
        return [], []
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return keys[np.append(0, cut)].tolist(), np.split(values[order], cut)


def _induce_wide(t: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The same for large alphabets, suffix by suffix."""
    s, tiny = t.tolist(), small.tolist()
    ends = np.cumsum(np.bincount(t))
    heads = (ends - np.bincount(t)).tolist()
    sa = [-1] * len(s)
    tails = ends.tolist()
    for p in seeds.tolist()[::-1]:
        tails[s[p]] -= 1
        sa[tails[s[p]]] = p
    for p in sa:  # the list grows under the loop
        j = p - 1
        if j >= 0 and not tiny[j]:
            c = s[j]
            k = heads[c]
            sa[k] = j
            heads[c] = k + 1
    tails = ends.tolist()
    for p in reversed(sa):
        j = p - 1
        if j >= 0 and tiny[j]:
            c = s[j]
            tails[c] = k = tails[c] - 1
            sa[k] = j
    sa[0] = len(s) - 1
    return np.array(sa)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The sorted suffixes of t, whose last entry is its only smallest one."""
    if len(t) < 3:
        return np.arange(len(t))[::-1]
    induce = _induce if len(np.unique(t)) <= WIDE_ALPHABET and len(t) > 2 * WIDE_ALPHABET else _induce_wide
    small = _smaller(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    first = induce(t, small, lms)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    by_part = first[is_lms[first]]
    # Names: leftmost-smaller substrings, up to and with the next one's first entry, are equal if their hashes are.
    end = np.append(lms[1:] + 1, len(t))
    size = end - lms
    base = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(base, size)
    cell = mix(mix(t[place + np.repeat(lms, size)].astype(np.uint64) + np.uint64(1)) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    code = np.zeros(len(t), np.uint64)
    code[lms] = mix(np.add.reduceat(cell, base) + size.astype(np.uint64))
    names = np.zeros(len(t), np.int64)
    names[by_part] = np.cumsum(np.concatenate([[0], code[by_part][1:] != code[by_part][:-1]]))
    reduced = names[lms]
    order = lms[suffix_array(reduced)] if reduced.max() + 1 < len(lms) else by_part
    return induce(t, small, order)


def common_prefixes(cells: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How far the runs from a and b agree, up to about 2 * most; cells are hashes of the entries."""
    power, width = [cells], 1
    while 2 * width <= most:
        h = power[-1]
        power.append(mix(h[: max(0, len(h) - width)] * np.uint64(0xD1342543DE82EF95) + h[width:]))
        width *= 2
    a, b, n = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in [len(power) - 1, *range(len(power) - 1, -1, -1)]:
        h, top = power[k], len(power[k]) - 1
        if top < 0:
            continue
        same = (a <= top) & (b <= top) & (h[np.minimum(a, top)] == h[np.minimum(b, top)])
        step = same.astype(np.int64) << k
        n, a, b = n + step, a + step, b + step
    return n


def repeated_places(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(flags, start of each body): which places of the bodies, laid end to end, start a string of `length` bytes found twice."""
    size = np.array([len(b) + 1 for b in bodies])
    base = np.cumsum(size) - size
    t = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.int64) + 2
    ends = base + size - 1
    t[ends] = 1
    t = np.append(t, 0)
    sa = suffix_array(t)
    cells = mix(t.astype(np.uint64) + np.uint64(77))
    cells[ends] = mix(np.arange(len(ends), dtype=np.uint64) + np.uint64(1 << 40))
    cells[-1] = mix(np.uint64([1 << 50]))[0]
    phi = np.full(len(t), -1)
    phi[sa[1:]] = sa[:-1]
    at = np.flatnonzero(phi >= 0)
    plcp = np.zeros(len(t), np.int64)
    plcp[at] = common_prefixes(cells, at, phi[at], length)
    hit = np.flatnonzero(plcp >= length)
    flags = np.zeros(len(t), bool)
    flags[hit] = flags[phi[hit]] = True
    return flags, base


def _undecided(bodies: list[bytes], length: int) -> list[bytes]:
    """The bodies that hold a window whose hash stands twice among them: all that sorting could find."""
    size = np.array([len(b) for b in bodies])
    units = passages._BYTE[np.frombuffer(b"".join(bodies), np.uint8)]
    code = passages.run_hashes(units, length)
    at = np.flatnonzero(passages.inner(np.append(0, np.cumsum(size)), length))
    order = at[np.argsort(code[at], kind="stable")]
    same = code[order][1:] == code[order][:-1]
    some = np.zeros(len(code) + 1, bool)
    some[order[1:][same]] = some[order[:-1][same]] = True
    base = np.cumsum(size) - size
    return [b for b, k in zip(bodies, np.logical_or.reduceat(some, np.minimum(base, len(code))).tolist(), strict=True) if k]


def _match(batches: Iterator[pa.RecordBatch], search: passages.Search) -> Iterator[pa.RecordBatch]:
    for batch in passages.groups(batches):
        h = batch.column("h").to_numpy()
        cuts = np.flatnonzero(h[1:] != h[:-1]) + 1
        ids, th, starts, n = (batch.column(c).to_pylist() for c in ("doc_id", "th", "starts", "n"))
        body, w = batch.column("body").to_pylist(), batch.column("w").to_pylist()
        out: list[tuple[int, int, int, int]] = []
        shard: dict[bytes, list[int]] = {}
        held = 0

        def close(shard=shard, out=out, ids=ids, th=th, starts=starts, n=n) -> None:
            bodies = _undecided(list(shard), search.length)
            if not bodies:
                return shard.clear()
            flags, base = repeated_places(bodies, search.length)
            for b, o in zip(bodies, base.tolist(), strict=True):
                for i in shard[b]:
                    on = flags[o : o + n[i]]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))).tolist()
                    out.extend((ids[i], th[i], s + x, s + y) for x, y in zip(edge[::2], edge[1::2], strict=True) for s in starts[i])
            shard.clear()

        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(h)], strict=True):
            rows: dict[bytes, list[int]] = {}
            for i in range(lo, hi):
                rows.setdefault(body[i], []).append(i)
            alone = len(rows) == 1
            for b, own in rows.items():
                several = sum(w[i] for i in own) > 1
                if several:
                    out += [(ids[i], th[i], s, s + n[i]) for i in own for s in starts[i]]
                if not alone or not several:
                    shard.setdefault(b, []).extend([] if several else own)
                    held += len(b)
            if held >= SHARD_BYTES:
                close()
                held = 0
        if shard:
            close()
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "th", "lo", "hi"])


def dedup(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed bytes, [from, to)) and kept (the remaining bytes) for each row."""
    search = passages.Search(passages.single_bytes, length, grams, b"", True, most)
    rows, ranges = passages.repeated(docs, search, _match, False)

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for text, whole, spans in zip(piece.column("text").to_pylist(), piece.column("whole").to_pylist(), piece.column("spans").to_pylist(), strict=True):
            raw = text or b""
            gone: list[dict] = []
            n = len(raw)
            if whole and n >= length:
                raw, gone = b"", [{"from": 0, "to": n}]
            elif spans and not whole:
                mask = passages.covered([(s["lo"], s["hi"]) for s in spans], length, n)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                gone = [{"from": a, "to": b} for a, b in edge.reshape(-1, 2).tolist()]
                raw = np.frombuffer(raw, np.uint8)[~mask].tobytes()
            for o, v in zip(out, (n, n - len(raw), gone, raw), strict=True):
                o.append(v)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])), pa.binary())
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = passages.marked(plain, rows, ranges).select("row.doc_id", F.col("text").cast("binary").alias("text"), "whole", "spans")
    return per_piece(marked, work, "doc_id long, n_bytes long, n_removed long, spans array<struct<from:long,to:long>>, kept binary")
