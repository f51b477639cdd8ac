"""Quality rules: per-document statistics, fixed base rules and an isolation forest over the statistics.

The forest isolates documents by random axis-parallel splits; short mean path lengths mean odd
statistics.  One part of it splits on the rates of all statistics and one on those of each statistic
alone, so that a document odd in a single one stands out; splits reach beyond the rows seen, by a
margin, as many statistics are 0 in nearly every good row.  It is grown on all good labelled rows that pass
the base rules, level by level: each level is one aggregate of all rows' number and ranges by node.  The
scores from which a document is rejected are calibrated on all labelled rows, by counting how many have
each score, so that at most `max_loss` of the good ones go.  Trees have at most DEPTH levels; what a leaf
still holds counts by the mean path of a tree of its rows.  Scores have PLACES decimal places.
A null text counts as one without words: all statistics
0, the base rule rejects it.  Rows are judged one by one, so repeated rows get equal results; with no
labelled rows the forest rejects nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, per_piece, tidy, written
from .tokens import SPACE, hashes, inner, mix, spans, text_of, texts, windows

TREES, DEPTH, SEED, MAX_LOSS, LOSS_WEIGHT = 64, 8, 7, 0.01, 60.0
PART_TREES, PART_LOSS, PLACES = 16, 0.05, 4
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines"]
COUNTS = BASE + MORE
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


_SYMBOL = _table(SYMBOLS)
_HEAD = (np.arange(256) & 0xC0) != 0x80


def _repeated(key: np.ndarray) -> np.ndarray:
    """Which entries have an equal one."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    flag = np.zeros(len(key), bool)
    flag[order[1:]] |= same
    flag[order[:-1]] |= same
    return flag


def counts(column) -> dict[str, np.ndarray]:
    """The statistics of each text of a column."""
    data, off, _ = texts(column)
    n = len(off) - 1
    start, end, first = spans(data, off)
    of = text_of(first, len(start))
    per = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])[off])
    owner = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = hashes(data, start, end)
    out = {"n_words": np.diff(first), "word_chars": per(_HEAD & ~SPACE), "n_symbols": per(_SYMBOL)}
    # Words inside runs of WINDOW words that stand twice or more in their text.
    w = windows(h, WINDOW)
    at = np.flatnonzero(inner(first, WINDOW)) if len(w) else np.zeros(0, np.int64)
    at = at[_repeated(mix(w[at] ^ owner[of[at]]))]
    step = np.zeros(len(start) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(of, np.cumsum(step)[:-1] > 0, n).astype(np.int64) if n else np.zeros(0, np.int64)
    # Lines with a word; all but the first of equal ones count.
    breaks = np.flatnonzero(data == 10)
    lo = np.sort(np.concatenate([off[:-1], breaks + 1]))
    hi = np.sort(np.concatenate([off[1:], breaks]))
    has = np.searchsorted(start, hi) > np.searchsorted(start, lo)
    lo, hi = lo[has], hi[has]
    line_of = np.searchsorted(off, lo, side="right") - 1
    full = mix(hashes(data, lo, hi) ^ owner[line_of]) if len(lo) else np.zeros(0, np.uint64)
    order = np.argsort(full, kind="stable")
    again = order[1:][full[order][1:] == full[order][:-1]]
    out["n_dup_lines"] = np.bincount(line_of[again], minlength=n)
    out["n_lines"] = np.bincount(line_of, minlength=n)
    return {c: out[c].astype(np.int64) for c in COUNTS}


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest splits on: rates, one column for each document."""
    # Some words, lines and characters are added below the line, so that short texts don't stand out.
    words, chars, lines = c["n_words"] + 20, c["word_chars"] + 100, c["n_lines"] + 4
    rate = lambda part, of: np.log1p(50 * part / of)
    return np.stack([chars / words, rate(c["n_symbols"], chars), rate(c["n_symbols"], words), rate(c["n_dup_lines"], lines), rate(c["n_repeat_words"], words), np.log(words / lines), np.log(words)])


#: How far splits reach beyond the rows seen, by feature, and the features of each part of the forest.
MARGIN = np.array([1.0, 0.5, 0.5, 1.0, 1.0, 0.75, 0.75])
PARTS = [list(range(7)), [0], [1, 2], [3], [4], [5], [6]]

#: The part of each tree and the features that it may split on.
PART_OF = np.repeat(np.arange(len(PARTS)), [TREES] + [PART_TREES] * (len(PARTS) - 1))
USES = np.array([[k in PARTS[p] for k in range(len(MARGIN))] for p in PART_OF])
RANGES = [f"{side}{k}" for side in ("low", "high") for k in range(len(MARGIN))]


def _mean_path(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    return np.where(n < 2, 0.0, np.where(n > 2, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m, 1.0))


def nodes(splits: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Where each document (column) stands in each tree (row) below the levels of splits, (feature, cut) by tree and node."""
    at, each = np.zeros((len(PART_OF), x.shape[1]), np.int64), np.arange(x.shape[1])
    for feature, cut in splits:
        node = at + np.arange(len(at))[:, None] * cut.shape[1]
        at = 2 * at + (x[feature.ravel()[node], each] >= cut.ravel()[node])
    return at


def _slices(x: np.ndarray) -> Iterator[np.ndarray]:
    """The documents (columns) a few at a time, so that their places in all trees stay in the cache."""
    return (x[:, i : i + 256] for i in range(0, x.shape[1], 256))


def _stats_of(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy() for c in COUNTS}


def _level(rows: DataFrame, splits: list[tuple[np.ndarray, np.ndarray]], ranges: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each tree and node below the splits: how many of the rows stand there, and each feature's range."""
    trees, width = len(PART_OF), 2 ** len(splits)
    columns = ["n", *RANGES] if ranges else ["n"]

    def work(batches):
        n, low = np.zeros(trees * width, np.int64), np.full((len(MARGIN), trees * width), np.inf)
        high = -low
        for batch in batches:
            for x in _slices(features(_stats_of(batch))):
                node = nodes(splits, x) + np.arange(trees)[:, None] * width
                n += np.bincount(node.ravel(), minlength=len(n))
                for k in range(len(MARGIN)) if ranges else ():
                    at = node[USES[:, k]]
                    value = np.broadcast_to(x[k], at.shape).ravel()
                    np.minimum.at(low[k], at.ravel(), value)
                    np.maximum.at(high[k], at.ravel(), value)
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(v[some]) for v in (np.arange(len(n)), n, *(low if ranges else ()), *(high if ranges else ()))], ["node", *columns])

    each = rows.mapInArrow(work, "node long, n long" + "".join(f", {c} double" for c in columns[1:]))
    # As many rows as the trees have nodes, however many documents there are.
    found = each.groupBy("node").agg(*((F.sum if c == "n" else F.min if c.startswith("low") else F.max)(c).alias(c) for c in columns)).toPandas()
    size, low = np.zeros(trees * width, np.int64), np.full((trees * width, len(MARGIN)), np.inf)
    high, at = -low, found["node"].to_numpy()
    size[at] = found["n"]
    if ranges:
        low[at], high[at] = found[RANGES[: len(MARGIN)]], found[RANGES[len(MARGIN) :]]
    return size.reshape(trees, width), low.reshape(trees, width, -1), high.reshape(trees, width, -1)


def grow(rows: DataFrame) -> dict:
    """Isolation trees over all rows: the splits of each level, the path length of each place below them and that expected of all rows."""
    rng, trees, splits = np.random.default_rng(SEED), len(PART_OF), []
    floor = np.full((trees, 1, len(MARGIN)), -np.inf)
    top, path, open_ = -floor, np.zeros((trees, 1)), np.ones((trees, 1), bool)
    for level in range(DEPTH + 1):
        size, low, high = _level(rows, splits, level < DEPTH)
        if not level:
            total = int(size[0, 0])
        path = np.where(open_, level + _mean_path(size), path)
        if level == DEPTH:
            break
        low, high = np.maximum(low - MARGIN, floor), np.minimum(high + MARGIN, top)
        wide = (high > low) & USES[:, None]
        open_ &= (size > 1) & wide.any(2) & (level < np.log2(max(2, total)))
        if not open_.any():
            break
        feature = np.where(wide, rng.random(wide.shape), -1.0).argmax(2)
        of = lambda v, f=feature: np.take_along_axis(v, f[..., None], 2)[..., 0]
        share = rng.random(feature.shape)
        with np.errstate(invalid="ignore"):
            cut = np.where(open_, of(low) + share * (of(high) - of(low)), np.inf)
        splits.append((feature, cut))
        # Left children, then right ones, beside each other; all rows of a leaf go left and keep its path.
        here = np.arange(len(MARGIN)) == feature[..., None]
        pair = lambda a, b: np.stack([a, b], 2).reshape(trees, 2 * a.shape[1], *a.shape[2:])
        floor, top = pair(floor, np.where(here, cut[..., None], floor)), pair(np.where(here, cut[..., None], top), top)
        path, open_ = pair(path, path), pair(open_, open_)
    return {"splits": splits, "path": path, "expected": max(float(_mean_path(total)), 1e-9), "rows": total}


def oddness(forest: dict, x: np.ndarray) -> np.ndarray:
    """2^(-mean path / expected path) by part of the forest: near 1 for odd documents, about 0.5 and less for ordinary ones."""
    out = [np.zeros((len(PARTS), 0))]
    for some in _slices(x):
        path = np.take_along_axis(forest["path"], nodes(forest["splits"], some), 1)
        out.append(np.stack([path[PART_OF == p].mean(0) for p in range(len(PARTS))]))
    return np.round(2 ** (-np.concatenate(out, 1) / forest["expected"]), PLACES)


def highest(forest: dict, x: np.ndarray) -> np.ndarray:
    """The highest oddness of each document over the forest's parts, each as a share of what its good rows reach."""
    return np.round((oddness(forest, x) / forest["reach"][:, None]).max(0), PLACES) if forest else np.zeros(x.shape[1])


def statistics(docs: DataFrame) -> DataFrame:
    """Each row's doc_id and statistics."""

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        c = counts(piece.column("text"))
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(c[k]) for k in COUNTS)], ["doc_id", *COUNTS])

    return per_piece(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, STATS_SCHEMA)


def _failed(n_words, n_repeat):
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def _counted(rows: DataFrame, scores: Callable[[np.ndarray], np.ndarray]) -> pd.DataFrame:
    """How many good and bad rows have each score, for each row of scores (part)."""

    def work(batches):
        for batch in batches:
            found = scores(features(_stats_of(batch)))
            part = np.repeat(np.arange(len(found)), found.shape[1])
            good = np.tile(batch.column("good").to_numpy(zero_copy_only=False), len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(found.ravel()), pa.array(good)], ["part", "score", "good"])

    each = rows.mapInArrow(work, "part long, score double, good long")
    # Scores have PLACES decimal places: there are a bounded number of them, however many documents there are.
    return each.groupBy("part", "score").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).toPandas().sort_values(["part", "score"])


def fit(docs: DataFrame, labels: DataFrame, max_loss: float = MAX_LOSS) -> dict:
    """The forest and its threshold, from all labelled rows."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # Of rows that repeat a doc_id the one of least statistics counts.
    seen = statistics(docs).where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("c"))
    rows = seen.join(known, "doc_id").select("c.*", (F.col("quality") == 1).alias("good"))
    rows = written(rows.where(~_failed(F.col("n_words"), F.col("n_repeat_words"))), "labelled")
    try:
        with tidy(docs.sparkSession):
            return _fitted(rows, max_loss)
    finally:
        drop(rows)


def _fitted(rows: DataFrame, max_loss: float) -> dict:
    forest = grow(rows.where("good"))
    if not forest["rows"]:
        return {"forest": [], "threshold": 2.0}
    # A share PART_LOSS of the loss may come from each part: the score at that place of all good rows.
    found = _counted(rows.where("good"), lambda x: oddness(forest, x))
    place = int(np.ceil((1 - PART_LOSS * max_loss) * (forest["rows"] - 1)))
    forest["reach"] = np.array([p["score"].to_numpy()[np.searchsorted(p["good"].cumsum(), place, side="right")] for _, p in found.groupby("part")])
    # Of the thresholds up to the parts' reach that lose at most max_loss of the good rows, the one with the best balance of bad rows caught against good rows lost.
    found = _counted(rows, lambda x: highest(forest, x)[None])
    score, good, bad = (found[c].to_numpy() for c in ("score", "good", "bad"))
    cuts = np.unique(np.append(score[score < 1], 1.0))
    upto = np.searchsorted(score, cuts, side="right")
    lost = 1 - np.append(0, good.cumsum())[upto] / good.sum()
    caught = 1 - np.append(0, bad.cumsum())[upto] / max(1, bad.sum())
    return {"forest": forest, "threshold": float(cuts[np.argmax(np.where(lost <= max_loss, caught - LOSS_WEIGHT * lost, -1.0))])}


def judge(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, the statistics, base_failed, score (oddness, 1 is where good rows end) and kept, one row for each row of docs."""
    forest, threshold = model["forest"], model["threshold"]

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        c = counts(piece.column("text"))
        failed = _failed(c["n_words"], c["n_repeat_words"])
        score = highest(forest, features(c))
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(c[k]) for k in COUNTS), pa.array(failed), pa.array(score), pa.array(~failed & (score <= threshold))], ["doc_id", *COUNTS, "base_failed", "score", "kept"])

    return per_piece(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, STATS_SCHEMA + ", base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs, with all their columns, that the rules and the forest keep."""
    forest, threshold = model["forest"], model["threshold"]

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        c = counts(piece.column("text"))
        score = highest(forest, features(c))
        return piece.filter(pa.array(~_failed(c["n_words"], c["n_repeat_words"]) & (score <= threshold)))

    return per_piece(docs, work, docs.schema)
