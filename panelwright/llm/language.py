"""Language identification by words first and character n-grams for words never seen.

A known word scores its log frequency in each language; an unseen one is cut into the longest known
n-grams (falling back from `MAX_N` to single characters) and scores their mean log frequency.  A text's
language is the one of highest sum, ties going to the first by code point.  Learning and prediction cut
texts alike: words are runs of ASCII letters, A-Z lower-cased, and characters beyond ASCII.

The model is fitted on a sample of labelled rows: about `TRAIN_ROWS` rows and `TRAIN_BYTES` of text, of
texts up to `TRAIN_TEXT_BYTES`.  It keeps every word and n-gram of them, so what is broadcast is bounded by
the sample.  Null texts and texts without a letter get `und` and score 0, and so does every text when
nothing could be learned.  Each row is judged by its text alone, so rows that repeat are judged alike;
texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_piece
from .licenses import LOWER as LOW
from .licenses import UPPER as UP
from .tokens import LOWER, hashes, spans, texts

TRAIN_ROWS, TRAIN_BYTES, TRAIN_TEXT_BYTES, MAX_N = 6_000, 32 << 20, 1 << 20, 4

GAP = np.ones(256, bool)
GAP[65:91] = GAP[97:123] = GAP[128:] = False
#: The same words as GAP's, as a pattern.
WORD = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def held_out(doc_id: Column) -> Column:
    """Rows kept out of training: those whose crc32(doc_id as text) mod 3 is 1, and those without doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def sample(docs: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(text, lang) of the labelled rows to learn from: those that `held_out` does not keep out, as many by a hash of doc_id as the bounds let in."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    rows = rows.where(F.octet_length("text") <= TRAIN_TEXT_BYTES)
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    part = min(1.0, train_rows / max(1, n), train_bytes / max(1, size))
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(part * (1 << 30))).select("text", "lang")


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each word stands in the texts of each language."""
    words = F.regexp_extract_all(F.translate("text", UP, LOW), F.lit(WORD), F.lit(0))
    return rows.select("lang", F.explode(words).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, gram, n): the n-grams, up to MAX_N, of words between `^` and `$`, counted as often as the words stand."""
    w = F.concat(F.lit("^"), "gram", F.lit("$"))

    def cut(size: int) -> Column:
        own = F.transform(F.sequence(F.lit(1), F.length(w) - size + 1), lambda i: F.substring(w, i, F.lit(size)))
        return F.when(F.length(w) >= size, own).otherwise(F.array().cast("array<string>"))

    some = F.flatten(F.array(*(cut(size) for size in range(1, MAX_N + 1))))
    return words.select("lang", F.explode(some).alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """The model, from sample(): for words and n-grams their names and log frequencies by language."""
    words = word_counts(sample(docs, train_rows)).persist()
    model: dict = {}
    for name, counts in (("words", words), ("grams", gram_counts(words))):
        got = counts.orderBy("gram", "lang").toArrow()
        langs = sorted(set(got.column("lang").unique().to_pylist()))
        names = got.column("gram").unique()
        at = np.searchsorted(langs, np.array(got.column("lang").to_pylist(), object)) if langs else np.zeros(0, int)
        row = got.column("gram").combine_chunks().dictionary_encode().indices.to_numpy() if len(got) else np.zeros(0, int)
        c = np.zeros((len(names), len(langs)))
        c[row, at] = got.column("n").to_numpy()
        model |= {"langs": langs, name: names.to_pylist(), f"{name}_log": np.log((c + 0.5) / (c.sum(0) + 0.5 * len(names) + 1)).astype(np.float32)}
    words.unpersist()
    return model


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score (the share of the best language among all, by probability) for each row."""
    langs = model["langs"]
    data, ends, _ = texts(pa.array(model["words"], pa.string()))
    known = hashes(data, ends[:-1], ends[1:])
    order = np.argsort(known)
    known, known_log = known[order], model["words_log"][order]
    grams, gram_log = {g: i for i, g in enumerate(model["grams"])}, model["grams_log"]
    shared = docs.sparkSession.sparkContext.broadcast((known, known_log, grams, gram_log))

    def backoff(word: str) -> np.ndarray:
        _, _, grams, gram_log = shared.value
        w, i, found = f"^{word}$", 0, []
        while i < len(w):
            for n in range(min(MAX_N, len(w) - i), 0, -1):
                g = grams.get(w[i : i + n])
                if g is not None:
                    found.append(g)
                    break
            else:
                n = 1
            i += n
        return gram_log[found].mean(0) if found else np.zeros(len(langs), np.float32)

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        known, known_log, _, _ = shared.value
        data, off, _ = texts(piece.column("text"))
        data = LOWER[data]
        start, end, first = spans(data, off, GAP)
        n = len(off) - 1
        total = np.zeros((n, max(1, len(langs))))
        if len(start) and langs:
            h, ix, inv = np.unique(hashes(data, start, end), return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            seen = known[at] == h if len(known) else np.zeros(len(h), bool)
            logs = np.zeros((len(h), len(langs)), np.float32)
            logs[seen] = known_log[at[seen]]
            for k in np.flatnonzero(~seen):
                logs[k] = backoff(data[start[ix[k]] : end[ix[k]]].tobytes().decode(errors="replace"))
            full = np.flatnonzero(np.diff(first))
            for lo in range(len(langs)):
                total[full, lo] = np.add.reduceat(logs[:, lo][inv].astype(float), first[:-1][full]) if len(full) else 0
        words = np.diff(first)
        ok = np.asarray(piece.column("letters").to_numpy(zero_copy_only=False), bool) & bool(langs)
        best = total.argmax(1)
        score = 1 / np.exp(np.clip(total - total.max(1, keepdims=True), -50, 0)).sum(1) if n else np.zeros(0)
        names = [langs[b] if o else "und" for b, o in zip(best, ok, strict=True)]
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(ok & (words >= 0), score, 0.0))], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return per_piece(rows, work, "doc_id long, lang_pred string, score double")
