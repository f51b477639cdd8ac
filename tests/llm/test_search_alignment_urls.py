"""Lexical search, tokenizer alignment and url filters against brute force on small tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import alignment, lexical, urls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Extra columns with names that the operators use inside.
EXTRA = "term string, score double, rank int, row long, pair string, host string, path string, rule string, short string, tags map<string,string>"
MORE = ("t", 1.0, 2, 3, "p", "h", "/p", "r", "s", {"a": "b"})


def prose(seed, n, size=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5))) for _ in range(size)]
    return " ".join(rng.choice(words) for _ in range(n))


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def ranked(docs, items, k):
    """Scores of all documents, sorted."""
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, wanted in asked.items():
        rows = []
        for i, c in own:
            n = sum(c.values())
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if s > 0:
                rows.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(rows, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


DOCS = [(i, prose(i % 7, 5 + 13 * i % 90)) for i in range(1, 60)] + [
    (60, None), (61, ""), (62, " ,;!"), (63, "Same WORDS here"), (64, "same words here"), (64, "same words here"), (None, "same words here"),
    (65, "x " * 20000 + "same"), (66, prose(3, 4000)), *((100 + i, "same words " + prose(9, 12)) for i in range(40)),
]
ITEMS = [(0, prose(0, 9)), (1, prose(3, 30)), (2, "same WORDS, unseen"), (3, "nowhere at_all?"), (4, None), (5, ""), (2, "here"), (6, prose(4, 200) + " same x"), (None, "same")]


@pytest.mark.parametrize(("shard", "block", "k", "batch"), [(1 << 20, 10**6, 50, 128), (3000, 40, 5, 2), (1, 10**6, 7, 1)])
def test_search(spark, monkeypatch, shard, block, k, batch):
    monkeypatch.setattr(lexical, "BATCH", batch)
    docs = spark.createDataFrame([(i, t, *MORE) for i, t in DOCS], f"doc_id long, text string, {EXTRA}").repartition(3)
    items = spark.createDataFrame([(i, t, *MORE) for i, t in ITEMS], f"item_id long, text string, {EXTRA}")
    got = lexical.search(lexical.build(docs, shard), items, k, block, seed_part=2)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == ranked(DOCS, ITEMS, k)


def test_search_of_empty_tables(spark):
    docs, items = (spark.createDataFrame(rows, s) for rows, s in ((DOCS, "doc_id long, text string"), (ITEMS, "item_id long, text string")))
    assert lexical.search(lexical.build(docs.limit(0)), items).count() == 0
    assert lexical.search(lexical.build(docs), items.limit(0)).count() == 0
    assert lexical.search(lexical.build(docs.where("doc_id in (60, 61, 62)")), items).count() == 0


def test_treap_bounds_every_cell():
    rng = np.random.default_rng(1)
    for rows, cols, n in ((1, 1, 1), (70, 9, 200), (5, 300, 400)):
        cell = np.unique(rng.integers(0, rows * cols, n))
        grid = lexical.Treap(cell // cols, cell % cols, rng.integers(1, 99, len(cell)))
        assert grid.peak[grid.root] == grid.peak[: len(cell)].max()
        level = {grid.root}
        for _ in range(grid.height):
            below = {int(c) for x in level for q in range(4) for c in grid.children(np.array([x]), np.array([q])) if c != grid.empty}
            assert all(max(grid.peak[c] for q in range(4) for c in grid.children(np.array([x]), np.array([q]))) == grid.peak[x] for x in level)
            level = below
        assert level == set(range(len(cell)))


def plain_alignment(rows):
    """Groups and links by walking both token lists of each row."""
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(alignment.BYTE_BPE)
    coder.encode_special_tokens = True
    letters = alignment.byte_letters()
    encode_b, table_b = alignment.piece_bpe(alignment.PIECE_BPE)
    found, held = [], Counter()
    for i, text in rows:
        a = b = []
        if text:
            a = [(x, len(bytes(letters[c] for c in coder.id_to_token(x)))) for x in coder.encode(" " + text, add_special_tokens=False).ids]
            b = [(x, len(table_b[x])) for x in encode_b([text])[0]]
            if b"".join(table_b[x] for x, _ in b) != (" " + text).encode():
                a = b = []
        groups, links, ia, ib, ea, eb = [], [], 0, 0, 0, 0
        while ia < len(a):
            ga, gb = [a[ia][0]], [b[ib][0]]
            ea, eb = ea + a[ia][1], eb + b[ib][1]
            links.append((ga[-1], gb[-1]))
            ia, ib = ia + 1, ib + 1
            while ea != eb:
                if ea < eb:
                    ga.append(a[ia][0])
                    ea, ia = ea + a[ia][1], ia + 1
                else:
                    gb.append(b[ib][0])
                    eb, ib = eb + b[ib][1], ib + 1
                links.append((ga[-1], gb[-1]))
            groups.append((ga, gb))
        text_of = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append((i, len(a), len(b), len(groups), links, hashlib.sha256(text_of.encode()).hexdigest() if groups else ""))
        held.update(set(links))
    most: dict = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    return sorted(((i, na, nb, g, len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), h) for i, na, nb, g, links, h in found), key=repr)


TEXTS = [
    "The quick brown fox, isn't it?", "The quick brown fox, isn't it?", None, "", " ", "  two  spaces\n\n\tand tabs ", "<|endoftext|> and </s> <unk>", "naïve café 漢字 😀😀 é\u0301", "1234567 89,01",
    "a" * 30000, " " * 5000, "x \u3000 y\u00a0z\x00\x01", "tokenization unbelievably internationalisation " * 40, "ll've 'RE we'll\r\n", "the the the", "ﬁne ½ ①",
]


@pytest.mark.parametrize("most", [alignment.MOST_PAIRS, 3])
def test_alignment(spark, most):
    rows = [*enumerate(TEXTS), (3, "again the same id"), (None, "no id at all"), (None, None)]
    docs = spark.createDataFrame([(i, t, *MORE) for i, t in rows], f"doc_id long, text string, {EXTRA}").repartition(3)
    got = alignment.align(docs, most_pairs=most)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr) == plain_alignment(rows)
    assert alignment.align(docs.limit(0), most_pairs=most).count() == 0


def test_alignment_of_broken_text(spark):
    docs = spark.createDataFrame([(1, bytearray(b"ab\xffcd")), (2, bytearray(b"abcd"))], "doc_id long, text binary")
    assert [r.n_a > 0 for r in alignment.align(docs).orderBy("doc_id").collect()] == [False, True]


def test_both_vocabularies_of_any_text():
    """The byte-level coder cuts random texts of all kinds of letters as the vocabulary's own library does."""
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(alignment.BYTE_BPE)
    coder.encode_special_tokens = True
    encode, _ = alignment.byte_bpe(alignment.BYTE_BPE)
    rng = random.Random(5)
    pool = [chr(c) for c in range(1, 0x7F)] + [" "] * 40 + ["\n", "\u00a0", "\u3000", "'s", "'ll"] + [chr(rng.randrange(0xA0, 0xD7FF)) for _ in range(200)]
    for _ in range(500):
        text = " " + "".join(rng.choice(pool) for _ in range(rng.randrange(1, 60)))
        assert encode(text).tolist() == coder.encode(text, add_special_tokens=False).ids


def test_pointer_jumping_over_long_chains():
    n = 5000  # neither side's cuts meet before the end
    end_a, end_b = np.append(np.arange(2, 2 * n, 2), 2 * n), np.append(np.arange(1, 2 * n, 2), 2 * n)
    last = alignment.terminals(end_a, end_b)
    assert (last == len(end_a) - 1).all()
    assert (alignment.terminals(end_a, end_a) == np.tile(np.arange(n), 2)).all()


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(UPPER)
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[2], max(fit)[3]
    return host, path, None, "allow" if host else "block"


URLS = [
    None, "", "no scheme/en/", "http://", "http:///en/x", "HTTP://WWW.Example.COM/en/1?x=/de/", "https://example.com/en/", "https://example.com/en", "https://a.b.example.com/en/2#y", "https://notexample.com/en/3", "http://x.net/es/", "http://x.net/ES/",
    "http://net/fr/", "http://x.net./fr/", "http://com", "http://com/", "http://x.com?/en/", "http://x.com#://net/es/", "ftp://user@www.example.com:80/en/", "x://y://www.example.com/en/", "http://" + "a." * 3000 + "com/" + "p/" * 3000, "http://exämple.com/ü", "http://.com/", "http://a..net/fr/", "http://x.net/es/", "http://x.net/\n/es/",
]
OWN = [*urls.RULES, ("block", "a.net", "/f"), ("allow", "net", "/fr/x"), ("block", "COM", "/"), ("block", "xn.com", ""), ("allow", "b.example.com", "/en/2"), ("block", "y", "/abc")]


@pytest.mark.parametrize(("rules", "short", "most"), [(urls.RULES, 8, 50_000), (OWN, 8, 50_000), (OWN, 1, 0), (OWN, 0, 50_000), ([], 8, 50_000)])
def test_url_filters(spark, rules, short, most):
    pages = spark.createDataFrame([(i, u, *MORE) for i, u in [*enumerate(URLS), (None, "http://x.net/es/1"), (3, "http://x.net/es/1")]], f"page_id long, url string, {EXTRA}").repartition(3)
    got = sorted((tuple(r) for r in urls.judge(pages, urls.rule_table(spark, rules), short, most).collect()), key=repr)
    one: dict = {}
    for v, h, p in rules:
        one[h.translate(UPPER), p] = max(v, one.get((h.translate(UPPER), p), v))
    flat = [(v, h, p) for (h, p), v in one.items()]
    want = [(r.page_id, *plain_verdict(r.url, flat)) for r in pages.collect()]
    assert got == sorted(want, key=repr)


def test_allowed_pages_keep_their_columns(spark):
    pages = spark.createDataFrame([(i, u, *MORE) for i, u in enumerate(URLS)], f"page_id long, url string, {EXTRA}")
    kept = urls.allowed(pages)
    assert kept.columns == pages.columns
    assert sorted(r.page_id for r in kept.collect()) == [i for i, u in enumerate(URLS) if plain_verdict(u, urls.RULES)[3] == "allow"]
    assert urls.judge(pages.limit(0)).count() == urls.allowed(pages.limit(0)).count() == 0


def test_url_filters_stay_in_the_engine(spark):
    pages = spark.createDataFrame([(1, "http://x.net/es/1")], "page_id long, url string")
    plan = urls.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        urls.judge(pages, spark.range(urls.MOST_SHAPES + 1).select(F.lit("block").alias("verdict"), F.lit("x").alias("host"), F.concat(F.lit("/"), F.repeat(F.lit("p"), F.col("id").cast("int"))).alias("path")))
