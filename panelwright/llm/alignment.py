"""Cross-tokenizer alignment: the finest groups of tokens of two tokenizers that cover the same bytes.

Both tokenizers cut the same bytes (a space and the text) into tokens.  Every token points to the
farthest-right token that overlaps it; where tokens of both sides end together, the first side's is the end
of its group and points to itself.  Doubling all successors at once until nothing changes leaves each token
at its group's last one, in as many rounds as the logarithm of the longest chain.

- A text that is null, empty, no valid UTF-8, or that a tokenizer does not give back byte by byte has no
  tokens: its numbers are 0 and its digest is the empty string.
- A link is a pair of overlapping token occurrences, one of each side.  An id pair's count is the number of
  rows of the table that hold it linked; rows that repeat a doc_id, or have none, count as rows of their own.
- Ties for an id's highest count are all best.  An empty table gives an empty result; further columns are
  not looked at.

Pair counts are sums with partial aggregation.  Up to `MOST_PAIRS` different pairs are sent to the tasks; more
are joined by a shuffle, in which a pair's rows are dealt by a salt.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_piece, written

#: Where the vocabularies lie on every machine.
BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
MOST_PAIRS, SALTS = 4_000_000, 32

#: Fixed value: how the byte-level vocabulary cuts a text into words before merging.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def byte_bpe(path: str):
    """(encode: text -> ids, bytes of each id) of a byte-level BPE vocabulary, whose ids rank its merges."""
    import tiktoken

    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    special = {t["id"] for t in given.get("added_tokens", [])}
    vocabulary = {i: w for w, i in given["model"]["vocab"].items()}
    table = [b"" if i in special or i not in vocabulary else bytes(letters[c] for c in vocabulary[i]) for i in range(max(vocabulary) + 1)]
    coder = tiktoken.Encoding("byte", pat_str=WORDS, mergeable_ranks={b: i for i, b in enumerate(table) if b}, special_tokens={})
    return (lambda text: coder.encode_to_numpy(text, disallowed_special=())), table


@lru_cache(maxsize=2)
def piece_bpe(path: str):
    """(encode: texts -> ids, bytes of each id) of a vocabulary of pieces; it puts the space before a text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        table.append(bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode())
    return (lambda texts: model.encode(texts, num_threads=1)), table


@lru_cache(maxsize=4)
def _tables(path: str, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each id of a vocabulary: its number of bytes, its decimals with room for a separator, and their number."""
    table = (byte_bpe if kind == "byte" else piece_bpe)(path)[1]
    text = [str(i).encode() for i in range(len(table))]
    width = len(text[-1]) + 1
    digits = np.frombuffer(b"".join(t.ljust(width) for t in text), np.uint8).reshape(len(text), width)
    return np.array([len(b) for b in table], np.int64), digits, np.array([len(t) for t in text], np.int64)


def terminals(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """For the tokens of the first and then of the second side, given by their ends: the last token of each one's group, by pointer jumping."""
    na = len(end_a)
    over = np.searchsorted(end_b, end_a)
    under = np.searchsorted(end_a, end_b)
    following = np.concatenate([np.where(end_b[over] > end_a, na + over, np.arange(na)), under])
    while True:
        farther = following[following]
        if (farther == following).all():
            return following
        following = farther


def _digest_bytes(ids: tuple[np.ndarray, np.ndarray], group: tuple[np.ndarray, np.ndarray], own: tuple[np.ndarray, np.ndarray], forms) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, their ends by text) of `a1,a2|b1;a3|b2,b3` for all texts; `own` are the tokens' texts."""
    (a, b), (ga, gb), (da, db) = ids, group, own
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    # In the text a group's tokens of the first side come first.
    at_a = np.arange(len(a)) + np.searchsorted(gb, ga, side="left")
    at_b = np.arange(len(b)) + np.searchsorted(ga, gb, side="right")
    n, width = len(a) + len(b), max(f[0].shape[1] for f in forms)
    cell, size, text = np.full((n, width), 32, np.uint8), np.empty(n, np.int64), np.empty(n, np.int64)
    for at, x, g, d, (digits, long), mark in ((at_a, a, ga, da, forms[0], 124), (at_b, b, gb, db, forms[1], 59)):
        cell[at, : digits.shape[1]] = digits[x]
        ends = np.append(g[1:] != g[:-1], True)
        cell[at, long[x]] = np.where(ends, mark, 44)
        size[at], text[at] = long[x] + 1, d
    size[np.flatnonzero(np.append(text[1:] != text[:-1], True))] -= 1  # nothing after a text's last token
    used = np.arange(width) < size[:, None]
    return cell[used], np.cumsum(np.bincount(text, size, int(text.max(initial=-1)) + 1).astype(np.int64))


def aligned(docs: DataFrame, byte_path: str = BYTE_BPE, piece_path: str = PIECE_BPE) -> DataFrame:
    """For each row of docs (doc_id, text): row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its different linked id pairs with their numbers."""
    many = len(piece_bpe(piece_path)[1])

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        encode_a, table_a = byte_bpe(byte_path)
        encode_b, table_b = piece_bpe(piece_path)
        raw = piece.column("text").to_pylist()
        n = len(raw)
        given, of = [], []
        for i, t in enumerate(raw):
            try:
                if t:
                    given.append(t.decode())
                    of.append(i)
            except UnicodeDecodeError:
                pass
        some_a, some_b, text = [], [], []
        for i, t, y in zip(of, given, encode_b(given), strict=True):
            x = encode_a(" " + t)
            whole = b" " + raw[i]
            if b"".join([table_b[k] for k in y]) == whole and b"".join([table_a[k] for k in x.tolist()]) == whole:
                some_a.append(x)
                some_b.append(y)
                text.append(i)
        text = np.array(text, np.int64)
        na, nb = (np.array([len(x) for x in side], np.int64) for side in (some_a, some_b))
        a = np.concatenate(some_a).astype(np.int64) if some_a else np.zeros(0, np.int64)
        b = np.fromiter(chain.from_iterable(some_b), np.int64, int(nb.sum()))
        (size_a, *form_a), (size_b, *form_b) = _tables(byte_path, "byte"), _tables(piece_path, "piece")
        end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        da, db = np.repeat(text, na), np.repeat(text, nb)
        last = terminals(end_a, end_b)
        terminal = np.zeros(len(a), np.int64)
        terminal[last] = 1
        number = np.cumsum(terminal) - 1
        group = number[last[: len(a)]], number[last[len(a) :]]
        data, stop = _digest_bytes((a, b), group, (da, db), (form_a, form_b))
        stop = np.concatenate([[0], stop, np.full(n - len(stop), stop[-1] if len(stop) else 0)])
        view = memoryview(data)
        has = np.zeros(n, bool)
        has[text] = True
        sums = [hashlib.sha256(view[stop[i] : stop[i + 1]]).hexdigest() if has[i] else "" for i in range(n)]
        # Between two neighbouring cuts of either side one token of each overlaps: a link.
        cuts = np.unique(np.concatenate([end_a, end_b]))
        ia, ib = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
        space = np.int64(len(table_a)) * many
        pair, times = np.unique(da[ia] * space + a[ia] * many + b[ib], return_counts=True)
        ends = np.searchsorted(pair // space, np.arange(n + 1))
        lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x)) for x in ((pair % space), times.astype(np.int32))]
        count = lambda d: pa.array(np.bincount(d, minlength=n).astype(np.int64))
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), count(da), count(db), count(da[terminal > 0]), count(da[ia]), pa.array(sums, pa.string()), *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = per_piece(rows, work, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")
    return found.withColumn("row", F.monotonically_increasing_id())


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count): how many rows hold each pair linked."""
    return rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))


def align(docs: DataFrame, byte_path: str = BYTE_BPE, piece_path: str = PIECE_BPE, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row of docs.

    n_best: links whose pair's count is the highest of its id of the first side; count_sum: the counts of all links.
    """
    spark = docs.sparkSession
    many = len(piece_bpe(piece_path)[1])
    rows = written(aligned(docs, byte_path, piece_path), "aligned")
    counts = written(pair_counts(rows), "pairs")
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    if counts.count() > most_pairs:
        a = F.floor(F.col("pair") / many)
        best = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
        judged = counts.withColumn("a", a).join(best, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.*").select("row", F.col("pairs").alias("pair"), "times", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"))
        sums = links.join(judged, ["pair", "salt"]).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
        out = rows.join(sums, "row", "left")
        return out.select(*plain, F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
    got = counts.toArrow()
    pair, count = (got.column(c).to_numpy() for c in ("pair", "count"))
    order = np.argsort(pair)
    pair, count = pair[order], count[order]
    most = np.zeros(int(pair.max(initial=0)) // many + 1, np.int64)
    np.maximum.at(most, pair // many, count)
    shared = spark.sparkContext.broadcast((pair, count, count == most[pair // many]))

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        pair, count, best = shared.value
        lists, times = piece.column("pairs"), piece.column("times").flatten().to_numpy()
        at = np.searchsorted(pair, lists.flatten().to_numpy())
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        total = lambda x: pa.array(_sums(owner, x, len(lists)))
        cols = [piece.column(c) for c in plain] + [total(times * best[at]), total(times * count[at]), piece.column("groups_sha256")]
        return pa.RecordBatch.from_arrays(cols, [*plain, "n_best", "count_sum", "groups_sha256"])

    schema = ", ".join(f"{c} long" for c in [*plain, "n_best", "count_sum"]) + ", groups_sha256 string"
    return per_piece(rows.select(*plain, "groups_sha256", "pairs", "times"), work, schema, "pairs")


def _sums(owner: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """The whole-number sums of x by ascending owner."""
    upto = np.concatenate([[0], np.cumsum(x.astype(np.int64))])
    return upto[np.searchsorted(owner, np.arange(n), side="right")] - upto[np.searchsorted(owner, np.arange(n))]
