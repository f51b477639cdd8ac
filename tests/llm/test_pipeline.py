"""The pipeline on a small corpus, stage by stage against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelwright.llm import mixing, quality
from panelwright.llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), int(k))) for k in rng.integers(2, 9, n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("corpus")
    shared = prose(1, 70)
    texts = {i: prose(10 + i, 60 + 7 * i) for i in range(40)}
    texts |= {100: texts[3], 101: texts[4].rsplit(" ", 1)[0], 102: prose(90, 40) + " " + shared + " " + prose(91, 40), 103: shared + " " + prose(92, 90)}
    texts |= {104: "# $ % " * 30, 105: "same words again and again " * 20, 106: "", 107: None, 108: "few words only", 109: "\n".join(["one line of several words here"] * 9)}
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in texts.items()]
    rows += [rows[0], (1, rows[2][1], "en", "s9", 1), (None, prose(95, 50), "en", "s0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(where / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 100), 0) for i in texts], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(where / "labels.parquet"))
    return str(where)


@pytest.fixture(scope="module")
def steps(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], folder), "stage"))
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]


def test_quality_stage(spark, folder, steps):
    docs, kept = rows_of(steps[0]), rows_of(steps[1])
    model = quality.fit(steps[0], spark.read.parquet(f"{folder}/labels.parquet"))
    judged = {(r.doc_id, r.n_words): r.kept for r in quality.judge(steps[0], model).collect()}
    assert sorted(kept, key=repr) == sorted((d for d in docs if judged[d[0], len(WORD.findall(d[1] or ""))]), key=repr)
    gone = {d[0] for d in docs} - {d[0] for d in kept}
    assert {104, 105, 106, 107, 108, 109} <= gone and len({d[0] for d in kept if d[0] is not None and d[0] < 40}) >= 38


def test_near_copies_stage(steps):
    before, after = rows_of(steps[1]), rows_of(steps[2])

    def shingles(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}

    named = [d for d in set(before) if d[0] is not None]
    root = {d[:2]: d[0] for d in named}
    for _ in named:
        for a in named:
            for b in named:
                x, y = shingles(a[1]), shingles(b[1])
                if 100 * len(x & y) >= 80 * len(x | y):
                    root[a[:2]] = root[b[:2]] = min(root[a[:2]], root[b[:2]])
        if all(root[d[:2]] <= d[0] for d in named):
            break
    want = {d[:2] for d in named if root[d[:2]] == d[0]}
    assert sorted(d[:2] for d in after if d[0] is not None) == sorted(want)
    assert [d for d in after if d[0] is None] == [d for d in before if d[0] is None] and not {100, 101} & {d[0] for d in after}


def test_substring_stage(steps):
    before, after = rows_of(steps[2]), rows_of(steps[3])

    def runs(text):
        w = WORD.findall(text)
        return [tuple(w[k : k + 13]) for k in range(len(w) - 12)]

    first: dict = {}
    for i, text, _, _ in before:
        for run in runs(text) if i is not None else ():
            first[run] = min(first.get(run, i), i)
    want = []
    for i, text, lang, source in before:
        gone = {k + j for k, run in enumerate(runs(text)) if i is not None and first[run] < i for j in range(13)}
        words = WORD.findall(text)
        want.append((i, " ".join(w for k, w in enumerate(words) if k not in gone) if gone else text, lang, source))
    assert sorted(after, key=repr) == sorted(want, key=repr) and sum(len(WORD.findall(d[1])) for d in after) < sum(len(WORD.findall(d[1])) for d in before)
    assert all(df.columns == steps[0].columns for df in steps[:5])


def test_mixing_stage(steps):
    plan = mixing.mix(steps[3]).collect()
    text = {(d[0], d[3]): d[1] for d in rows_of(steps[3])}
    mixed = rows_of(steps[4])
    for i, t, _, source in mixed:
        assert t == text[i, source] or " ".join(WORD.findall(t)) in " ".join(WORD.findall(text[i, source]))
    for source in {r.source for r in plan}:
        words = sum(len(WORD.findall(d[1])) for d in mixed if d[3] == source)
        assert abs(words - next(r.target for r in plan if r.source == source)) <= 0.5 and words == sum(r.taken for r in plan if r.source == source)


def test_packing_stage_and_run(spark, folder, steps):
    packed = steps[5].collect()
    assert sum(r.length for r in packed) == sum(len(WORD.findall(d[1])) for d in rows_of(steps[4]))
    used: dict = {}
    for r in packed:
        used[r.bin_id, r.capacity] = used.get((r.bin_id, r.capacity), 0) + r.length
    assert all(n <= cap for (b, cap), n in used.items() if b is not None)
    ran = corpus_pipeline.run(spark, folder)
    assert sorted(map(repr, ran.collect())) == sorted(map(repr, packed))
    assert steps[4].where(F.col("text").isNull()).count() == 0
