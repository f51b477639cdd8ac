"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import json
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.llm import chat, common, jaccard, language, licenses, mixing, near_vectors, packing, passages, quality, queries, substrings, suffix_arrays

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdeé"), 4)) for _ in range(n))


BASE, SHARED = sentence(1, 120), sentence(2, 60)
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.replace(" ", "\n", 3) + " tail", "en", "b"), (4, sentence(3, 40) + " " + SHARED + " " + sentence(4, 40), "de", None),
    (5, sentence(5, 30) + " " + SHARED + " " + sentence(6, 70), None, "b"), (6, None, "en", "b"), (7, "", "en", "a"), (8, "one two", "en", "a"), (9, "x " * 3000, "en", "a"),
    (10, SHARED, "fr", "c"), (None, SHARED, "fr", "c"), (8, "one two", "en", "a"), (11, "a" * 900, "en", "c"), (12, "123 456", None, None), (13, "THE Apache  License, Version 2.0; under the MIT license! CC-BY-NC 4.0 cc by nc", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


PHRASE = sentence(7, 7) + " "
#: Texts that repeat one phrase: many stretches of few minimizers.
CROWD = [(20, PHRASE * 60 + sentence(8, 20)), (21, sentence(9, 5) + " " + PHRASE * 50), (22, PHRASE * 40 + "end"), *((30 + i, sentence(40 + i, 30) + " " + SHARED + " " + sentence(70 + i, 20)) for i in range(9)), (31, sentence(41, 30))]


@pytest.fixture(scope="module")
def crowd(spark, docs):
    return docs.union(spark.createDataFrame([(i, t, "en", "a", len(t), 1, 2) for i, t in CROWD], SCHEMA)), [(r[0], r[1]) for r in ROWS] + CROWD


@pytest.mark.parametrize("most", [substrings.MOST, 2])
def test_substrings(crowd, none, most):
    table, rows = crowd
    runs = [[tuple(w[i : i + 13]) for i in range(len(w) - 12)] for w in (WORD.findall(t or "") for _, t in rows)]
    first: dict = {}
    for (i, _), own in zip(rows, runs, strict=True):
        for w in own:
            if i is not None:
                first[w] = min(first.get(w, i), i)
    want = []
    for (d, text), own in zip(rows, runs, strict=True):
        words = WORD.findall(text or "")
        gone = {i + k for i, w in enumerate(own) if d is not None and first[w] < d for k in range(13)}
        want.append((d, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    got = [tuple(r) for r in substrings.dedup(table, most=most).select("doc_id", "n_words", "n_removed", "kept").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert substrings.dedup(none).count() == 0
    assert substrings.deduplicated(table).columns == table.columns


def test_reference_automaton(docs):
    found = {r.doc_id: r.longest for r in substrings.against(docs, docs.where("doc_id = 10")).collect()}
    assert found[4] >= 60 and found[6] == 0 and found[8] == 0
    with pytest.raises(ValueError):
        substrings.against(docs, docs, most_words=10)


@pytest.mark.parametrize("most", [suffix_arrays.MOST, 2])
def test_suffix_arrays(crowd, none, most):
    table, rows = crowd
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen: dict = {}
    for i, b in raw:
        for k in range(len(b) - 199) if i is not None else ():
            seen[b[k : k + 200]] = seen.get(b[k : k + 200], 0) + 1
    want = []
    for i, b in raw:
        gone = {k + j for k in range(len(b) - 199) if i is not None and seen[b[k : k + 200]] > 1 for j in range(200)}
        want.append((i, len(b), len(gone), hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in gone)).hexdigest()))
    got = [tuple(r) for r in suffix_arrays.dedup(table, most=most).select("doc_id", "n_bytes", "n_removed", F.sha2("kept", 256)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert suffix_arrays.dedup(none).count() == 0


@pytest.mark.parametrize("search", [passages.Search(passages.words, 13, substrings.GRAMS, b" ", False, 3), passages.Search(passages.single_bytes, 200, suffix_arrays.GRAMS, b"", True, 3)])
def test_shards_are_bounded(spark, search):
    """No shard holds more than `most` different stretches, whatever a text repeats."""
    texts = [(i, sentence(100 + i, 40) + " " + SHARED + " " + sentence(200 + i, 40), i) for i in range(12)] + [(20 + i, PHRASE * 300 + "x" * i, 1) for i in range(3)]
    table = spark.createDataFrame(texts, "doc_id long, text string, th long")
    every = search.minimizers(table).groupBy("doc_id").agg(F.collect_set("h").alias("many")).withColumn("few", F.array().cast("array<long>")).join(table.select("doc_id", "th"), "doc_id")
    rows = search.travelling(table, every).select("h", "doc_id", "th", F.array("start").alias("starts"), "n", "body", F.lit(1).cast("long").alias("w"))
    shards, _ = passages.bounded(rows, search, True)
    sizes = [r["count"] for s in shards for r in s.groupBy("h").count().collect()]
    assert len(shards) > 1 and max(sizes) <= search.most
    assert rows.groupBy("h").count().agg(F.max("count")).first()[0] > 100


def test_induced_sorting():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 40, 3000):
        t = np.append(rng.integers(1, 4, n), 0)
        assert suffix_arrays.suffix_array(t).tolist() == sorted(range(n + 1), key=lambda i, t=t: tuple(t[i : i + 300]))


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard(spark, docs, none, size, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "HEAVY", 3)
    more = [(100 + i, " ".join(BASE.split()[: 120 - i % 9] + [f"w{i}"]), "en", "a", 1, 1, 1) for i in range(12)]
    rows = [(r[0], r[1]) for r in ROWS] + [(r[0], r[1]) for r in more]
    table = docs.union(spark.createDataFrame(more, SCHEMA))
    sets = {}
    for i, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i, text] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    known = [k for k in sets if k[0] is not None and sets[k]]
    for a in known:
        for b in known:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)), key=lambda k: k[0])
                root[y] = x
    want = [(k[0], len(sets[k]), None if k[0] is None else min(j[0] for j in sets if j[0] is not None and top(j) == top(k))) for k in rows]
    got = [tuple(r)[:3] for r in jaccard.near_duplicates(table, size, percent).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    if size == 3:
        assert jaccard.near_duplicates(none, size, percent).count() == 0


def test_shared_passage_makes_no_family(spark, monkeypatch):
    """A passage of many documents, whose shingles the sketch doesn't tell from others, doesn't join them to one family; near copies with it still link."""
    monkeypatch.setattr(jaccard, "HEAVY", 3)
    monkeypatch.setattr(jaccard, "CHUNK_SHINGLES", 200)
    monkeypatch.setattr(jaccard, "frequencies", lambda docs, size: np.zeros(2, np.int64))
    passage = sentence(70, 14)
    texts = [(i, f"{sentence(1000 + i, 30 + i)} {passage} {sentence(2000 + i, 20)}") for i in range(60)]
    texts += [(100 + i, f"{texts[i][1]} end{i}") for i in range(5)]
    table, seen, families = spark.createDataFrame(texts, "doc_id long, text string"), [], jaccard._families
    monkeypatch.setattr(jaccard, "_families", lambda nodes, *more: seen.append(nodes.count()) or families(nodes, *more))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(table).collect()}
    assert got == {i: i - 100 if i >= 100 else i for i, _ in texts}
    assert seen[0] < 20


def test_many_small_sets_in_bounded_memory():
    """A chunk's size is bounded in shingles: with sets of a few it holds very many, whose matrix must not be held at once."""
    import tracemalloc

    rng = np.random.default_rng(8)
    sets = [np.sort(rng.choice(1 << 30, 3, replace=False).astype(np.uint64)) for _ in range(6000)]
    sets[5000], ids = sets[10], np.arange(6000)
    tracemalloc.start()
    edges = jaccard._joined(ids, sets, ids, sets, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {tuple(sorted(e)) for e in edges} == {(10, 5000)} and peak < 150e6


def test_written_tables_reach_python_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(common, "BATCH_BYTES", 1 << 20)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    rows = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 200_000).alias("text"))
    held = spark.conf.get(common.BATCH, None)
    assert common.written(rows.mapInArrow(sizes, "n long"), "sizes").agg(F.max("n")).first()[0] < 3e6
    assert spark.conf.get(common.BATCH, None) == held


@pytest.mark.parametrize("percent", [90, 60])
def test_large_families(spark, percent, monkeypatch):
    """Pivots, homes and the rest against brute force: tight groups, a chain, loose copies of one text, unrelated sets, equal distances."""
    monkeypatch.setattr(jaccard, "CHUNK_SHINGLES", 1500)
    monkeypatch.setattr(jaccard, "PIVOTS", 4)
    rng = np.random.default_rng(percent)
    new = iter(rng.permutation(1 << 20).tolist())
    fresh = lambda k: [next(new) for _ in range(k)]
    sets = {}
    for group in range(3):
        base = fresh(60)
        for i in range(80 >> group):
            sets[1000 * group + i] = base[i % 3 :] + fresh(i % 4)
    walk = fresh(50)
    for i in range(40):
        walk = walk[2:] + fresh(2)
        sets[4000 + i] = list(walk)
    loose = fresh(100)
    for i in range(40):
        sets[5000 + i] = rng.permutation(loose).tolist()[6:] + fresh(3)
    for i in range(60):
        sets[6000 + i] = [7, *fresh(1 + i)]
    family = {k: (1 if k < 7000 else 2) for k in sets}
    for i in range(5):
        sets[8000 + i], family[8000 + i] = sets[i], 2
    nodes = spark.createDataFrame([(k, len(set(v)), family[k]) for k, v in sets.items()], "rep long, n long, family long")
    table = spark.createDataFrame([(k, len(set(v)), bytearray(np.sort(np.array(list(set(v)), np.uint64)).tobytes())) for k, v in sets.items()], "rep long, n long, keys binary")
    last = []
    within = jaccard._within
    monkeypatch.setattr(jaccard, "_within", lambda rows, *more: last.append(rows.count()) or within(rows, *more))
    got = {tuple(r) for r in jaccard._families(nodes, table, percent).collect()}

    def components_of(edges):
        root = {k: k for k in sets}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            x, y = sorted((top(a), top(b)))
            root[y] = x
        return {k: top(k) for k in sets}

    whole = {k: set(v) for k, v in sets.items()}
    links = {(a, b) for a in sets for b in sets if a < b and family[a] == family[b] and 100 * len(whole[a] & whole[b]) >= percent * len(whole[a] | whole[b])}
    assert {tuple(sorted(e)) for e in got} <= links
    assert components_of(got) == components_of(links)
    assert last[0] < len(sets) - 80


def test_representatives(spark):
    near = BASE.rsplit(" ", 2)[0]
    rows = [(5, BASE, "b"), (5, BASE, "a"), (5, SHARED, "a"), (2, near, None), (7, SHARED, "a"), (8, None, "x"), (8, None, "x"), (None, BASE, "n"), (None, BASE, "n"), (9, "one two", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _th string")
    got = sorted((tuple(r) for r in jaccard.representatives(docs).collect()), key=repr)
    assert got == sorted([(2, near, None), (8, None, "x"), (None, BASE, "n"), (None, BASE, "n"), (9, "one two", "q")], key=repr)


def test_vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 32))
    v[10:20] = v[0] + 0.05 * rng.normal(size=(10, 32))
    v[20] = v[21]
    v[22] = 3 * v[23]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(90, None), (91, [0.0] * 32), (92, [float("nan")] * 32), (93, []), (94, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(60, dtype=bool)
    comp = list(range(60))
    for _ in range(60):
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))]) for i in range(60)]
    want = [(i, int(near[i].sum()), comp[i], comp[i] == i) for i in range(60)] + [(i, 0, i, True) for i in range(90, 95)]
    assert sorted(tuple(r) for r in near_vectors.near_duplicates(table).collect()) == want


def test_vectors_of_any_size(spark):
    rows = [(1, [1e-200, 2e-200]), (2, [2e-200, 4.1e-200]), (3, [1e200, -1e200]), (4, [2e200, -2.1e200]), (5, [-1.0, 0.5]), (5, [-1.0, 0.5]), (6, [1e308, -1e-308])]
    got = {r.vec_id: r for r in near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {i: r.n_links for i, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0} and got[2].component_id == 1 and got[4].component_id == 3
    assert near_vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_licenses(docs, none):
    got = {r.doc_id: r for r in licenses.scan(docs).collect() if r.doc_id in (6, 13)}
    assert [(d.label, d.first, d.last) for d in got[13].base] == [("mit", 6, 9), ("apache-2", 1, 4), ("cc-by-nc", 10, 12), ("cc-by-nc", 15, 17)] and got[6].n_words == 0
    assert licenses.scan(none).count() == 0 and len(licenses.rules()) > 450


def test_license_places_against_brute_force(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["under", "the", "MIT", "License", "apache", "version", "2", "CC", "by", "nc", "é", "x", "Kit"]
    gaps = [" ", "-", ",  ", "\n", "/", "\x01"]
    texts = ["".join(w + str(rng.choice(gaps)) for w in rng.choice(vocabulary, int(rng.integers(0, 60)))) for _ in range(150)] + [None, "", "under the mit license " * 400, "no license here"]
    rows = {r.doc_id: r for r in queries_of(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hits = [(k, label) for p, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None), ",".join(sorted({a for _, a in hits})))
        assert set(r.base_labels.split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r.score <= 1


def queries_of(found):
    return queries.license_digest(found)


def test_license_priority_and_containment(spark):
    texts = ["licensed under the apache license version 2 0", "apache license version 2 0 and mit license", "gpl version 3 gpl"]
    got = {r.doc_id: [(d.label, d.first, d.last) for d in r.detections] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert set(got[0]) == {("apache-2", 0, 7)}  # what lies within it is suppressed
    assert ("mit", 6, 7) in got[1] and ("apache-2", 0, 4) in got[1] and not any(a == "apache" for a, _, _ in got[1])
    assert ("gpl-3", 0, 2) in got[2] and ("gpl", 3, 3) in got[2] and ("gpl", 0, 0) not in got[2]


REAL = [
    ("under the terms of the GNU General Public License version 3", "gpl-3"), ("GNU General Public License version 2", "gpl-2"), ("GPLv3", "gpl-3"), ("version 2 of the GNU General Public License", "gpl-2"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "gpl-3"), ("GNU Lesser General Public License, version 2.1", "lgpl-2.1"), ("LGPL-2.1-or-later", "lgpl-2.1"),
    ("GNU Affero General Public License v3.0", "agpl-3"), ("subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2"), ("Eclipse Public License - v 2.0", "epl-2"), ("Common Development and Distribution License (CDDL) Version 1.0", "cddl-1"),
    ("Licensed under the Apache License, Version 2.0", "apache-2"), ("Apache-2.0", "apache-2"), ("BSD 3-Clause License", "bsd-3.clause"), ("the 2-clause BSD license", "bsd-2.clause"), ("Modified BSD License", "bsd-3.clause"), ("BSD license", "bsd"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and", "mit"), ("The MIT License", "mit"), ("released under MIT", "mit"), ("ISC License", "isc"), ("zlib License", "zlib"), ("The origin of this software must not be misrepresented;", "zlib"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"), ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("All advertising materials mentioning features or use of this software must display the following acknowledgement", "bsd-4.clause"), ("The Artistic License 2.0", "artistic-2"), ("Boost Software License - Version 1.0", "bsl-1"), ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("The Unlicense", "unlicense"), ("WTFPL version 2", "wtfpl-2"), ("Python Software Foundation License Version 2", "psf-2"), ("SIL Open Font License, Version 1.1", "ofl-1.1"), ("European Union Public Licence v. 1.2", "eupl-1.2"), ("Open Database License v1.0", "odbl-1"),
    ("CeCILL v2.1", "cecill-2.1"), ("Microsoft Public License (Ms-PL)", "ms-pl"), ("Universal Permissive License v 1.0", "upl-1"), ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "cc-by-nc-sa"), ("CC BY-SA 3.0", "cc-by-sa"), ("CC0 1.0 Universal", "cc0"),
    ("You may not use this file except in compliance with the License.", "apache-2"), ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "mit"),
    ("You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lgpl"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"), ("Redistributions in binary form must reproduce the above copyright notice,", "bsd"),
    ("https://www.eclipse.org/legal/epl-2.0/", "epl-2"), ("The Software shall be used for Good, not Evil.", "json"), ("Unauthorized copying of this file, via any medium, is strictly prohibited", "proprietary"), ("Ce logiciel est régi par la licence CeCILL", "cecill"), ("Server Side Public License, version 1", "sspl-1"),
    ("Altered source versions must be plainly marked as such,", "zlib"), ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3", "gfdl"), ("No part of this book may be reproduced", "proprietary"), ("Business Source License 1.1", "busl-1.1"),
    ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2"), ("All rights reserved.", "proprietary"), ("dedicated to the public domain", "public-domain"),
]


def test_licenses_in_real_wordings(spark):
    plain = ["the apache helicopter and the mit campus", "an artistic boost of zlib", "the general public and a commit limit"]
    rows = licenses.scan(spark.createDataFrame(list(enumerate([t for t, _ in REAL] + plain)), "doc_id long, text string")).collect()
    got = {r.doc_id: {d.label for d in r.detections} for r in rows}
    assert [(t, want, got[i]) for i, (t, want) in enumerate(REAL) if want not in got[i]] == []
    assert all(not got[len(REAL) + i] for i in range(len(plain)))
    assert {"gpl-3"} == got[0] and {"lgpl-2.1"} == got[5] and {"agpl-3"} == got[7]
    assert {x[0] for x in licenses.rules()} >= {w for _, w in REAL}


def test_language(docs, none):
    found = language.identify(docs, language.fit(docs)).collect()
    assert len(found) == len(ROWS) and {r.lang_pred for r in found if r.doc_id in (6, 7, 12)} == {"und"}
    assert all(r.lang_pred == "und" for r in language.identify(docs, language.fit(none)).collect())


def test_language_against_brute_force(spark, docs):
    train = [(100 + i, t, a) for i in range(12) for t, a in (("the cat and the dog went home", "en"), ("der hund und die katze gehen heim", "de"), ("le chat et le chien", "fr"))]
    model = language.fit(spark.createDataFrame([(i, t, a) for k, (i, t, a) in enumerate(train)], "doc_id long, text string, lang string"))
    texts = ["The dog, und the katze!", "hundert chatons", "gehend", "zzz qqq", "É é", "42", "", None, "der der the"]
    got = [(r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    known = {w: model["words_log"][i] for i, w in enumerate(model["words"])}
    grams = {g: model["grams_log"][i] for i, g in enumerate(model["grams"])}
    for text, (pred, score) in zip(texts, got, strict=True):
        if not re.search(r"[^\W\d_]", text or ""):
            assert (pred, score) == ("und", 0.0)
            continue
        total = np.zeros(len(model["langs"]))
        for w in re.findall(r"[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
            if w in known:
                total += known[w]
                continue
            rest, found = f"^{w}$", []
            while rest:
                n = next((n for n in range(min(language.MAX_N, len(rest)), 0, -1) if rest[:n] in grams), 0)
                found += [grams[rest[:n]]] if n else []
                rest = rest[max(n, 1) :]
            total += np.mean(found, 0) if found else 0
        assert pred == model["langs"][int(total.argmax())] and abs(score - 1 / np.exp(total - total.max()).sum()) < 1e-4


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out(F.col("doc_id")))
    assert rows.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3 * mixing.LEAST_BLOCK
    assert mixing.mix(none).count() == 0
    assert sum(len(WORD.findall(r.text)) for r in mixing.mixed_documents(docs).collect()) == sum(r.taken for r in rows if r.doc_id is not None) + sum(r.taken for r in rows if r.doc_id is None)


def test_mixing_targets_against_brute_force(docs):
    rows = mixing.mix(docs).collect()
    size = {}
    for r in ROWS:
        size[r[3]] = size.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(size.values()), {}, set(order)
    while open_:
        share = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 2 * size[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in full}
        open_ -= full
    for r in rows:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6
    assert sorted((r.doc_id or -1, r.size) for r in rows) == sorted((r[0] or -1, len(WORD.findall(r[1] or ""))) for r in ROWS)
    assert sorted(map(repr, mixing.mix(docs).collect())) == sorted(map(repr, rows))


def test_mixing_of_tiny_sources(spark):
    huge = [(i, "w " * 4000, "huge") for i in range(30)]
    tiny = [(100 + i, "a b c" if i % 2 else "a b c d e f g h i j k l", f"tiny{i}") for i in range(40)]
    rows = mixing.mix(spark.createDataFrame(huge + tiny, "doc_id long, text string, source string")).collect()
    assert len(rows) == 70
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5 and own[0].target > 0
        assert all(r.taken == sum(c["to"] - c["from"] for c in r.copies) for r in own)


def test_mixing_blocks_stop_growing(spark):
    big = spark.createDataFrame([(0, "a", 6e8, 6e8), (1, "b", 40.0, 40.0)], "sid int, source string, source_size double, target double")
    slots, size = mixing.schedule(big)
    done = mixing.completed(slots, big, size)
    assert size == mixing.MOST_BLOCK and slots.count() > mixing.SLOTS
    assert [(r.block, r["limit"]) for r in done.where("sid = 1").collect()] == [(0, 40)] and done.where("sid = 0").count() == -(-600_000_000 // size)


def test_packing(docs, none):
    rows = [r for r in packing.pack(docs, capacities=(64, 128, 512)).collect()]
    bins: dict = {}
    for r in rows:
        if r.bin_id is not None:
            bins.setdefault((r.bin_id, r.capacity), []).append(r.length)
    assert all(sum(v) <= c and not any(sum(v) <= k < c for k in (64, 128)) for (_, c), v in bins.items())
    assert sum(r.length for r in rows) == sum(len(WORD.findall(r[1] or "")) for r in ROWS) and packing.pack(none).count() == 0
    laid: dict = {}
    for r in sorted((r for r in rows if r.bin_id is not None), key=lambda r: r["place"]):
        assert r["place"] == laid.get(r.bin_id, 0)
        laid[r.bin_id] = r["place"] + r.length


def test_packing_splits_equal_rows(spark):
    table = spark.range(600).selectExpr("cast(1 as long) as doc_id", "'a b c' as text")
    rows = packing.pack(table, capacities=(8, 16), shard_items=50).collect()
    shards: dict = {}
    for r in rows:
        shards[r.bin_id >> 32] = shards.get(r.bin_id >> 32, 0) + 1
    assert len(rows) == 600 and len(shards) == 12 and max(shards.values()) < 100


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (4, 1), (9, 0), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.judge(docs, model).collect()}
    assert len(quality.judge(docs, model).collect()) == len(ROWS) and got[9].base_failed and got[9].n_repeat_words == 3000 and got[6].n_words == 0 and got[1].kept
    assert quality.judge(none, quality.fit(none, labels)).count() == 0


def test_quality_counts_against_brute_force(spark):
    rng = np.random.default_rng(6)
    texts = ["".join(str(w) + str(rng.choice([" ", "\n", "  ", "\t", "\n\n"])) for w in rng.choice(["a", "bb", "é#", "$", "c|d", "\u3000"], int(rng.integers(0, 80)))) for _ in range(120)] + [t for _, t, _, _ in ROWS] + ["\n\n", "a\na\na\n a\n"]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), {"forest": [], "threshold": 2.0}).collect()}
    for i, text in enumerate(texts):
        words = WORD.findall(text or "")
        runs = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        twice = {k + j for k, run in enumerate(runs) if runs.count(run) > 1 for j in range(5)} if len(words) < 1000 else set(range(len(words)))
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 10 or 100 * len(twice) > 20 * len(words)) and r.kept != r.base_failed


def test_quality_of_documents_odd_in_one_statistic(spark):
    rng = np.random.default_rng(3)
    words = lambda n, k=5: ["".join(rng.choice(list("abcdefghij"), k + int(i % 3) - 1)) for i in range(n)]
    lines = lambda w, per: "\n".join(" ".join(w[i : i + per]) for i in range(0, len(w), per))
    good = [(i, lines(words(int(rng.integers(80, 600))), int(rng.integers(15, 50)))) for i in range(300)]
    run = words(19)
    odd = {
        "plain": lines(words(200), 30), "many equal short lines": "\n".join(f"see the next\n{lines(words(9), 9)}" for _ in range(25)), "repeats just below the base rule": lines(words(80) + run + words(5) + run + words(80), 30),
        "a word a line": lines(words(200), 1), "one long line": lines(words(5000), 5000), "very long": lines(words(60000), 30), "long words": lines(words(200, 9), 30), "symbols": lines(words(200), 30).replace("a", "#", 60),
    }
    docs = spark.createDataFrame(good + list(enumerate(odd.values(), 1000)), "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, 1) for i, _ in good], "doc_id long, quality int"))
    rows = {r.doc_id: r for r in quality.judge(docs, model).collect()}
    assert not any(rows[1000 + i].base_failed for i in range(len(odd)))
    assert [name for i, name in enumerate(odd) if rows[1000 + i].kept] == ["plain"]
    assert sum(not rows[i].kept for i, _ in good) <= 3
    assert {r.doc_id for r in quality.keep_good(docs, model).collect()} == {i for i, r in rows.items() if r.kept}


def test_quality_is_fitted_on_all_labelled_rows(spark):
    # 24,000 good rows; the 2,000 of greatest hash are of another kind, which a sample by hash doesn't show.
    ids = [r.id for r in spark.range(24_000).orderBy(F.xxhash64("id"), "id").collect()]
    kinds = dict.fromkeys(ids, " ".join(f"word{i}" for i in range(40))) | dict.fromkeys(ids[-2000:], " ".join(f"#w{i}" for i in range(40)))
    docs = spark.createDataFrame([*kinds.items(), (30_000, "#" * 3000 + " w1 w2 w3 w4 w5 w6 w7 w8 w9")], "doc_id long, text string")
    model = quality.fit(docs, spark.range(24_000).selectExpr("id as doc_id", "1 as quality"))
    gone = [r.doc_id for r in quality.judge(docs, model).where("not kept").collect()]
    assert gone == [30_000]


def test_quality_forest_against_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(sentence(1000 + 3 * i + j, int(rng.integers(12, 90))) + str(rng.choice(["", "\n", " # ", "\nab cd\nab cd\n"])) for j in range(3)) for i in range(400)]
    labels = [int(rng.random() < 0.8) for _ in texts]
    docs = spark.createDataFrame([*enumerate(texts), (1, texts[1])], "doc_id long, text string")
    known = spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int")
    model = quality.fit(docs.repartition(7), known, max_loss=0.05)
    again = quality.fit(docs.coalesce(1), known.repartition(3), max_loss=0.05)
    assert all((a == b).all() for one, other in zip(model["forest"]["splits"], again["forest"]["splits"]) for a, b in zip(one, other)) and (model["forest"]["path"] == again["forest"]["path"]).all() and model["threshold"] == again["threshold"]
    rows = {r.doc_id: r for r in quality.judge(docs, model).collect()}
    fine = [i for i, r in rows.items() if not r.base_failed]
    good = [i for i in fine if labels[i]]
    x = quality.features(quality.counts(pa.array(texts)))
    splits, deep = model["forest"]["splits"], {}

    def walk(tree, level, node, inside):
        """The path length of each good row, and of each place below the splits, by recursion."""
        feature, cut = (int(splits[level][0][tree, node]), splits[level][1][tree, node]) if level < len(splits) else (0, np.inf)
        if cut == np.inf:
            n = len(inside)
            deep[tree, node << (len(splits) - level)] = level + (0 if n < 2 else 1 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n)
            return
        assert len(inside) > 1 and quality.USES[tree, feature]
        values = [x[feature, i] for i in inside]
        assert min(values) - quality.MARGIN[feature] <= cut <= max(values) + quality.MARGIN[feature]
        walk(tree, level + 1, 2 * node, [i for i in inside if x[feature, i] < cut])
        walk(tree, level + 1, 2 * node + 1, [i for i in inside if x[feature, i] >= cut])

    for tree in range(len(quality.PART_OF)):
        walk(tree, 0, 0, good)
    assert model["forest"]["rows"] == len(good) and all(np.isclose(model["forest"]["path"][tree, node], path) for (tree, node), path in deep.items())
    odd = quality.oddness(model["forest"], x[:, good])
    assert [np.quantile(o, 1 - quality.PART_LOSS * 0.05, method="higher") for o in odd] == model["forest"]["reach"].tolist()
    # No threshold within the loss has a better balance over all labelled rows.
    score, bad = np.array([rows[i].score for i in good]), np.array([rows[i].score for i in fine if not labels[i]])
    balance = lambda cut: (bad > cut).mean() - quality.LOSS_WEIGHT * (score > cut).mean() if (score > cut).mean() <= 0.05 else -1
    assert np.isclose(balance(model["threshold"]), max(balance(c) for c in {*score[score < 1], *bad[bad < 1], 1.0}))


def test_chat(spark):
    calls = spark.createDataFrame([(9, 0, "s", "f", '{"a":"\\ud800"}', []), (1, 0, "a", "f", '{"x": 1, "a": "é"}', ["b"]), (1, 1, "b", "f", '{"a": 2}', []), (1, 2, "c", "g", "{", ["d"]), (1, 3, "d", "f", '{"a":"z"}', ["c"]), (None, 4, "e", "f", None, []), (1, 5, "b", "f", '{"a":"z"}', None)], chat.CALL)
    results = spark.createDataFrame([(1, 9, "a", "r"), (1, 10, "a", "s"), (1, 11, "zz", "?")], chat.RESULT)
    got = {(r.call_id, r.turn): r for r in chat.link(calls, results, {"f": {"required": ["a"], "properties": {"a": {"type": "string"}}}}).collect()}
    assert got["a", 0].level == 1 and got["a", 0].status == "answered again" and got["a", 0].problem == "" and '"arguments":{"a":"é","x":1}' in got["a", 0].json
    assert got["b", 1].problem == "a is not string" and got["c", 2].status == "cyclic" and got["e", 4].status == "unlinked" and got["zz", 11].status == "orphan result" and got["b", 5].status == "repeated call"


def test_chat_levels_against_brute_force(spark):
    rng = np.random.default_rng(4)
    waits = {(1, f"c{i}"): [f"c{i - 1}"] if i else [] for i in range(70)}  # one long chain
    waits |= {(2, f"c{i}"): sorted({f"c{j}" for j in rng.integers(0, 40, int(rng.integers(0, 3))) if j < i}) for i in range(40)}
    waits |= {(3, f"c{i}"): sorted({f"c{j}" for j in rng.integers(0, 40, int(rng.integers(0, 3)))}) for i in range(40)}  # with cycles
    waits |= {(4, "a"): ["a"], (4, "b"): ["a"], (4, "c"): ["gone"], (4, "d"): ["c", "gone"], (4, "e"): ["d", "b"]}
    level = {k: None for k in waits}
    for _ in waits:
        for (conv, call), on in waits.items():
            own = [level[conv, x] for x in on if (conv, x) in waits]
            if None not in own:
                level[conv, call] = max(own, default=-1) + 1
    rows = [(conv, i, call, "f", "{}", on) for i, ((conv, call), on) in enumerate(waits.items())]
    got = {(r.conv_id, r.call_id): r for r in chat.link(spark.createDataFrame(rows, chat.CALL), spark.createDataFrame([], chat.RESULT), {"f": {}}).collect()}
    assert {k: r.level for k, r in got.items()} == level
    assert {k for k, r in got.items() if r.status == "cyclic"} == {k for k, v in level.items() if v is None} and max(v for v in level.values() if v is not None) == 69


def test_chat_arguments():
    schema = {"properties": {"a": {"type": ["string", "null"]}, "b": {"type": "null"}, "c": {"type": "odd"}}}
    assert chat.valid('{"a":null,"b":null,"c":1}', schema)[1] == "" and chat.valid('{"a":1}', schema)[1] == "a is not string or null"
    assert chat.valid('{"a":"\\ud800é"}', schema) == ('{"a":"\\ud800é"}', "") and chat.valid("NaN", schema) == (None, "not JSON") and chat.valid(None, schema)[1] == "not an object"


def test_chat_keeps_every_turn(spark):
    inline = '{"content":"wait","tool_calls":[{"id":"x","name":"f","arguments":"{}"},{"id":"y","name":"f","arguments":"{}"}]}'
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "ho"), (1, 3, None, "who?"), (1, 4, "assistant", inline), (1, 5, "tool", '{"tool_call_id":"x","content":"one"}'),
        (1, 6, "tool", '{"tool_call_id":"x","content":"two"}'), (1, 6, "tool", '{"tool_call_id":"x","content":"two"}'), (1, 7, "tool", "no id"), (1, 8, "judge", None), (1, 9, "assistant", '{"tool_calls":[]}'), (None, None, "system", "lost"), (1, 10, "user", '{"tool_call_id":"y","content":"three"}'),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.link(*chat.from_turns(turns), chat.REPLY, chat.other_turns(turns)).collect()
    assert len(got) == len(rows) + 2
    seen = sorted((r.turn if r.turn is not None else -1, r.status) for r in got)
    assert seen == [
        (-1, "system turn"), (0, "system turn"), (1, "linked"), (2, "result"), (3, "no role"), (4, "answered again"), (4, "linked"), (4, "turn with calls"), (5, "result"),
        (6, "repeated result"), (6, "repeated result"), (7, "tool turn without id"), (8, "other role"), (9, "turn with calls"), (10, "result"),
    ]
    assert next(r.json for r in got if r.turn == 0) == '{"role":"system","status":"system turn","text":"be kind","turn":0}'
    assert all('"result":"two"' in r.json for r in got if r.turn == 6) and any('\\"content\\":\\"wait\\"' in r.json for r in got if r.turn == 4)


def test_chat_query_keeps_every_turn(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert queries.op5_chat_formatting(spark, "/root/testdata/sf0.01").count() == turns.count()


def test_suppression_against_brute_force(spark):
    rng, levels = np.random.default_rng(3), [10, 20, 25, 40]
    rows = []
    for size in (0, 1, 2, 3, 10, 60, 200):
        first = rng.integers(0, 40, size)
        rows.append([(f"l{rng.integers(0, 4)}", int(f), int(f + rng.integers(0, 9)), int(rng.choice(levels))) for f in first])
    found = spark.createDataFrame(list(enumerate(rows)), "i int, found array<struct<label:string,first:long,last:long,priority:int>>")
    for r in found.select("found", licenses.surviving(F.col("found"), levels).alias("kept")).collect():
        own = {tuple(d) for d in r.found}
        over = lambda d, e: e != d and e[1] <= d[1] and e[2] >= d[2] and e[3] >= d[3] and (e[2] - e[1] > d[2] - d[1] or e[3] > d[3] or e[0] < d[0])
        assert sorted(tuple(d) for d in r.kept) == sorted(d for d in own if not any(over(d, e) for e in own))


def test_licenses_of_a_text_with_100000_detections(spark):
    text = "cc by 4 0 zlib license " * 50_000
    row = licenses.scan(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).select("n_words", F.size("detections").alias("n"), "score").collect()
    assert [(r.n_words, r.n) for r in row] == [(300_000, 100_000)] * 2


CLASHES = ["_key", "_id", "_th", "_whole", "_spans", "_size", "_nth", "_c", "_row", "_order", "row", "whole", "spans", "kept", "n_words", "size", "nth", "p_size", "own_id", "th", "id", "a.b", "taken", "copies", "sid", "rest"]


def test_clashing_columns(spark, docs):
    """Columns of any name and type come through each operator of the pipeline as they were."""
    extra = {c: (F.col("doc_id") * 10 + i) for i, c in enumerate(CLASHES)}
    wide = docs.select("doc_id", "text", "lang", "source", "n_chars", *(v.alias(c) for c, v in extra.items()), F.create_map(F.lit("k"), F.col("doc_id")).alias("m"))
    for name, result in (("near", jaccard.representatives(wide)), ("cut", substrings.deduplicated(wide)), ("mix", mixing.mixed_documents(wide))):
        assert result.columns == wide.columns and result.dtypes == wide.dtypes, name
        rows = result.collect()
        assert rows, name
        for r in rows:
            if r.doc_id is not None:
                assert [r[c] for c in CLASHES] == [r.doc_id * 10 + i for i in range(len(CLASHES))] and r.m == {"k": r.doc_id}, name


def test_mixing_points_and_many_sources(spark):
    far = spark.range(2**33, 2**33 + 4).select(mixing.point(F.col("id")).alias("u")).distinct()
    assert far.count() == 4
    assert [r.u for r in spark.range(4).select(mixing.point(F.col("id")).alias("u")).orderBy("id").collect()] == [0, 0.5, 0.25, 0.75]
    many = spark.range(100_000).select("id", F.concat(F.lit("s"), F.col("id")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 5 + 1).cast("int")).alias("text")).union(spark.range(200).select("id", F.lit("huge"), F.repeat(F.lit("w "), F.lit(2000)))).withColumnRenamed("id", "doc_id")
    rows = mixing.mix(many).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    assert rows.count() == 100_001 and rows.where("abs(taken - target) > 0.5000001").count() == 0


def test_language_learns_the_words_it_looks_up(spark):
    """Letters beyond ASCII, among them spaces, belong to a word on both sides; long texts, ties and repeated rows."""
    words = {"en": "a\u00a0b\u3000c", "de": "Ä\u2003ö"}
    train = [(200 + i, f"{t} {t}", a) for i in range(12) for a, t in words.items()]
    table = spark.createDataFrame([(i, t, a) for i, (_, t, a) in enumerate(train)], "doc_id long, text string, lang string")
    counted = {(r.lang, r.gram) for r in language.word_counts(language.sample(table)).collect()}
    assert counted == {("en", "a\u00a0b\u3000c"), ("de", "Ä\u2003ö")}
    model = language.fit(table)
    texts = ["A\u00a0B\u3000C", "Ä\u2003ö", "Ä\u2003ö", "Ä\u2003ö " * 300_000, "a\u00a0b\u3000c Ä\u2003ö"]
    got = [r.lang_pred for r in language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert got[:4] == ["en", "de", "de", "de"]
    own = {w: model["words_log"][i] for i, w in enumerate(model["words"])}
    total = sum(own[w] for w in texts[4].split(" "))
    assert got[4] == model["langs"][int(np.argmax(total))]


def test_language_grams_against_a_loop(spark):
    rows = [("en", "abc", 3), ("en", "é", 2), ("de", "abc", 1)]
    want: dict = {}
    for lang, w, n in rows:
        for k in range(1, language.MAX_N + 1):
            for i in range(len(w) + 2 - k + 1):
                key = (lang, f"^{w}$"[i : i + k])
                want[key] = want.get(key, 0) + n
    got = language.gram_counts(spark.createDataFrame(rows, "lang string, gram string, n long"))
    assert {(r.lang, r.gram): r.n for r in got.collect()} == want


def test_a_cluster_needs_its_shared_folder(spark, monkeypatch):
    from panelwright.llm import common

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda key, other: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(RuntimeError):
        common.shared_folder(Cluster())


def plain_best_fit(lengths, capacities, openings, overhead):
    """(room left, size opened) of each bin: the fullest open bin that takes the item, of equal ones the last touched."""
    bins, fill, closed, clock = [], 0.9, 1, 0
    for n in lengths:
        clock += 1
        fit = [b for b in bins if b["room"] >= n]
        if fit:
            b = min(fit, key=lambda b: (b["room"], -b["touched"]))
        else:
            may = [c for c in openings if c >= n] or [capacities[-1]]
            b = {"size": min(may, key=lambda c: ((c + overhead) / (n + (c - n) * fill), c))}
            b["room"] = b["size"]
            bins.append(b)
        b["room"] -= n
        b["touched"] = clock
        if not b["room"]:
            closed += 1
            fill += (1.0 - fill) / closed
    used = [b["size"] - b["room"] for b in bins]
    return sorted((u, min(c for c in capacities if c >= u)) for u in used)


def test_packing_against_brute_force(spark):
    rng, sizes, overhead = np.random.default_rng(8), (64, 128, 512), 16
    n = [int(x) for x in rng.integers(0, 300, 150)] + [513, 1500, 64, 64, 64]
    docs = spark.createDataFrame([(i, "w " * k) for i, k in enumerate(n)], "doc_id long, text string")
    rows = packing.pack(docs, capacities=sizes, overhead=overhead).collect()
    pieces = sorted((min(512, k - at) for k in n for at in range(0, k, 512)), reverse=True)
    ways = [plain_best_fit(pieces, sizes, sizes[k:], overhead) for k in range(len(sizes))]
    best = min(ways, key=lambda w: sum(c + overhead for _, c in w))
    bins: dict = {}
    for r in rows:
        if r.bin_id is not None:
            bins.setdefault((r.bin_id, r.capacity), []).append(r.length)
    assert sorted((sum(own), c) for (_, c), own in bins.items()) == best
    # Ties: documents of one length and repeated rows fill bins alike, whatever their order.
    ties = spark.createDataFrame([(i % 7, "w " * 100) for i in range(30)], "doc_id long, text string")
    a, b = (sorted(map(tuple, packing.pack(x, capacities=sizes).collect())) for x in (ties, ties.repartition(5)))
    assert a == b and len(a) == 30


def test_chat_statuses_against_brute_force(spark):
    rng = np.random.default_rng(6)
    pick = lambda *xs: xs[int(rng.integers(0, len(xs)))]
    calls = [(pick(1, 2, None), int(t), pick("a", "b", "c", "d", "e", "f", None), "f", "{}", []) for t in rng.integers(0, 40, 25)]
    results = [(pick(1, 2, None), int(t), pick("a", "b", "c", "d", "x", None), pick("r", "s", None)) for t in rng.integers(0, 40, 40)]
    want = []
    for conv, turn, call, *_ in calls:
        first = min((c[1] for c in calls if c[:1] == (conv,) and c[2] == call), default=None)
        own = sorted((r[1], r[3] is not None, r[3] or "") for r in results if r[0] == conv and r[2] == call)
        if conv is None or call is None:
            status = "unlinked"
        elif turn > first:
            status = "repeated call"
        elif not own:
            status = "unanswered"
        else:
            status = "answered early" if own[0][0] < turn else "answered again" if len(own) > 1 else "linked"
        want.append((conv, turn, call, "call", status))
    told = set()
    for conv, turn, call, text in results:
        own = sorted((r[1], r[3] is not None, r[3] or "") for r in results if r[0] == conv and r[2] == call)
        if conv is None or call is None or not any(c[0] == conv and c[2] == call for c in calls):
            status = "orphan result"
        else:
            here = (turn, text is not None, text or "")
            status = "result" if here == own[0] and (conv, call) not in told else "repeated result"
            told |= {(conv, call)} if status == "result" else set()
        want.append((conv, turn, call, "result", status))
    got = chat.link(spark.createDataFrame(calls, chat.CALL), spark.createDataFrame(results, chat.RESULT), {"f": {}}).collect()
    kind = lambda r: "call" if '"arguments"' in r.json else "result"
    assert sorted(((r.conv_id, r.turn, r.call_id, kind(r), r.status) for r in got), key=repr) == sorted(want, key=repr)
    empty = chat.link(spark.createDataFrame([], chat.CALL), spark.createDataFrame([], chat.RESULT), {})
    assert empty.count() == 0


def test_mixing_takes_against_brute_force(spark):
    """What a document gives is its share of the blocks that its source's stream gives, read from the stream word by word."""
    rows = [(i, "w " * int(k), f"s{i % 3}") for i, k in enumerate(np.random.default_rng(2).integers(0, 90, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = mixing.targets(docs.groupBy("source").agg(F.sum(F.size(F.filter(F.split("text", " "), lambda w: w != ""))).cast("long").alias("source_size")))
    slots, size = mixing.schedule(target)
    blocks: dict = {}
    for r in mixing.completed(slots, target, size).join(target, "sid").collect():
        blocks.setdefault(r.source, set()).update(range(r.block * size, min((r.block + 1) * size, r["limit"])))
    for r in mixing.mix(docs).collect():
        at = [e * r.source_size + r.start + k for e in range(2) for k in range(r.size)]
        assert r.taken == sum(x in blocks[r.source] for x in at)


def test_vectors_with_further_columns(spark):
    """Columns of the operator's own names, repeated rows and null ids change nothing."""
    rows = [(1, [1.0, 0.0], 7, "x", 3, {"a": "b"}), (2, [1.0, 0.001], 8, None, 4, None), (2, [1.0, 0.001], 8, None, 4, None), (None, [1.0, 0.0], 9, "y", 5, None), (3, [0.0, 1.0], 1, "z", 6, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, v string, n long, block map<string,string>")
    got = sorted(map(tuple, near_vectors.near_duplicates(table).collect()), key=repr)
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (3, 0, 3, True), (None, 0, None, False)], key=repr)


def test_chat_of_long_texts(spark):
    long = "é" * 3_000_000
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long + '"\\'), (2, 0, "system", long)], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in chat.link(*chat.from_turns(turns), chat.REPLY, chat.other_turns(turns)).collect()}
    assert got[1, 0].status == "linked" and got[1, 1].status == "result" and got[2, 0].status == "system turn"
    assert json.loads(got[1, 0].json)["result"] == long + '"\\' and json.loads(got[1, 0].json)["arguments"]["text"] == long


def test_quality_of_long_texts(spark):
    words = sentence(1, 200_000)
    texts = [words, "a b c d e " * 100_000, "line of words here now\n" * 50_000, "#" * 2_000_000]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id long, text string"), {"forest": [], "threshold": 2.0}).collect()}
    assert (got[0].n_words, got[0].n_dup_lines, got[0].n_repeat_words, got[0].base_failed) == (200_000, 0, 0, False)
    assert (got[1].n_words, got[1].n_repeat_words, got[1].base_failed) == (500_000, 500_000, True)
    assert (got[2].n_dup_lines, got[2].base_failed) == (49_999, True) and (got[3].n_symbols, got[3].n_words) == (2_000_000, 1)


def test_tables_of_a_job_are_dropped_with_it(spark, tmp_path):
    """What near_duplicates() wrote on the way goes, what its result reads stays; so too where a job fails."""
    folder = Path(common.shared_folder(spark))
    before = {p.name for p in folder.iterdir()}
    words = " ".join(f"w{i}" for i in range(40))
    out = jaccard.near_duplicates(spark.createDataFrame([(1, words), (2, words + " more"), (3, "other text")], "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in out.collect()} == {1: 1, 2: 1, 3: 3}
    new = {p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name not in before}
    assert {"prefixes", "classes", "links"} <= new
    assert not new & {"heads", "busy", "members", "pairs", "nodes", "sets"}

    def fails():
        common.written(spark.range(3), "unused")
        raise ValueError("stop")

    with pytest.raises(ValueError, match="stop"):
        common.settled(fails, "never")
    assert not [p for p in folder.iterdir() if p.name.startswith(("unused", "never"))]
    assert not common._open
