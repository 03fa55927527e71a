"""Periodic runs, language identification and hard negatives against plain versions, and their odd rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm import hard_negatives as hard
from tempora.llm.hard_negatives import hard_negatives
from tempora.llm.language_id import fit, identify, language_id
from tempora.llm.periodic_runs import collapse_runs, runs_of, segments
from tempora.llm.queries import with_periods

FOLDER = "/root/testdata/sf0.001"


def plain_runs(w):
    """Every stretch of a period that cannot be extended, if it has no shorter period."""
    n, found = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            stretch = w[i : i + length]
            if j > i and length >= max(6, 4 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_equal_a_plain_search(letters):
    rng = random.Random(letters)
    for _ in range(150):
        w = []
        while len(w) < rng.randint(0, 120):
            piece = [rng.choice("abcde"[:letters]) for _ in range(rng.randint(1, 6))]
            w += piece * rng.choice([1, 1, 2, 4, 5, 9])
        assert runs_of(w) == plain_runs(w)
    assert runs_of(["a"] * 5) == [] and runs_of(["a"] * 6) == [(0, 6, 1)]
    assert runs_of("a b a b a b a b a".split()) == [(0, 9, 2)]


def test_segments_hold_frequent_words_only():
    rng = random.Random(5)
    w = np.array([rng.randint(0, 40) for _ in range(400)] + [1, 2, 3] * 5 + [rng.randint(0, 90) for _ in range(400)])
    found = list(segments(w, 4, 6))
    for lo, hi in found:
        assert np.unique(w[lo:hi], return_counts=True)[1].min() >= 4
    assert any(lo <= 400 and hi >= 415 for lo, hi in found)


def test_run_query_equals_its_contract(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    texts |= {10**6 + i: t for i, t in enumerate([None, "", " \n", "x " * 50, "a b c d " * 9 + "e"] * 8)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in collapse_runs(with_periods(docs)).collect()}
    assert len(got) == len(texts)
    changed = 0
    for i, text in texts.items():
        w, h = (text or "").encode().split(), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a, changed = g % n, changed + 1
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        runs = plain_runs(w) if n < 1500 else runs_of(w)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        assert [tuple(r) for r in got[i].runs] == runs and got[i].n_words == n
        assert got[i].collapsed.encode() == b" ".join(x for k, x in enumerate(w) if k not in gone)
    assert changed > 10


def test_run_digests(spark):
    from tempora.llm.queries import op11_periodic_runs
    got = op11_periodic_runs(spark, FOLDER).collect()
    runs = {r.doc_id: r for r in collapse_runs(with_periods(spark.read.parquet(f"{FOLDER}/documents.parquet"))).collect()}
    for r in got:
        of = runs[r.doc_id]
        assert r.collapsed_sha256 == hashlib.sha256(of.collapsed.encode()).hexdigest()
        assert r.runs_sha256 == hashlib.sha256("".join(f"{x.start},{x.length},{x.period}\n" for x in of.runs).encode()).hexdigest()
        top = min(of.runs, key=lambda x: (-x.length, x.start, x.period), default=None)
        assert (r.start, r.length, r.period) == ((top.start, top.length, top.period) if top else (None, None, None))
        assert r.exponent_milli == (1000 * top.length // top.period if top else None) and r.n_runs == len(of.runs)


def test_very_long_texts(spark):
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 300)}" for _ in range(60_000)] + [f"p{i}" for i in range(9_000)] * 5 + ["z"] * 50_000
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "y" * 2_000_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in collapse_runs(docs).collect()}
    assert (60_000, 45_000, 9_000) in [tuple(r) for r in got[1].runs] and (105_000, 50_000, 1) in [tuple(r) for r in got[1].runs]
    assert got[2].n_words == 1 and got[2].runs == []
    with pytest.raises(ValueError):
        collapse_runs(docs, times=2)


def held_out(docs):
    return F.crc32(docs["doc_id"].cast("string")) % 5 == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: r for r in language_id(docs, ~held_out(docs)).collect()}
    want = {r.doc_id: r.lang for r in docs.where(held_out(docs)).select("doc_id", "lang").collect()}
    assert np.mean([got[i].lang_pred == lang for i, lang in want.items()]) >= 0.95
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())


def test_language_never_reads_the_label_of_a_row(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kernel = fit(docs, ~held_out(docs))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("x"))
    assert sorted(identify(docs, kernel).collect()) == sorted(identify(other, kernel).collect())
    assert kernel.languages == ["de", "en", "es", "fr"]


def test_language_sums_equal_one_matrix(spark):
    """The dual weights from summed parts equal those of the whole kernel matrix."""
    from tempora.llm.language_id import RIDGE, WIDTH, columns_of, landmarks, training_sample
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(120)
    kernel = fit(docs, F.lit(True), count=6, sample=20)
    rows = training_sample(docs, F.lit(True), 20)
    of, bits = landmarks(rows, 6)
    base = np.stack([np.unpackbits(b).astype(float) for b in bits])
    used = base.any(axis=0)
    x, y = np.zeros((rows.count(), WIDTH)), np.zeros((rows.count(), len(kernel.languages)))
    for i, r in enumerate(rows.collect()):
        x[i, columns_of(r.text)] = 1
        y[i, kernel.languages.index(r.lang)] = 1
    x, base = x[:, used], base[:, used]
    base /= np.sqrt(base.sum(axis=1))[:, None]
    k = x @ base.T / np.sqrt(x.sum(axis=1))[:, None]
    dual = np.linalg.solve(k.T @ k + RIDGE * len(x) * (base @ base.T) + 1e-9 * len(x) * np.eye(len(base)), k.T @ y)
    assert np.allclose(base.T @ dual, kernel.weights, atol=1e-3) and sorted(set(of)) == kernel.languages


def test_columns_are_the_words_letter_ngrams():
    from tempora.llm.language_id import columns_of
    def grams(text):
        found = set()
        for word in text.split():
            for run in "".join(c if c.isalpha() else " " for c in word.lower()).split():
                run = f" {run} "
                found |= {run[i : i + n] for n in range(1, 6) for i in range(len(run) - n + 1)} - {" "}
        return found
    for text in ("Ab ab, c4d! the-end", "a", "é ß Ø \U00010400x", "one " * 99 + "two"):
        assert len(set(columns_of(text).tolist())) == len(grams(text))
    assert set(columns_of("ab cd").tolist()) == set(columns_of("CD\nab ab 77").tolist())
    assert len(columns_of("12 ² --")) == len(columns_of(None)) == 0


def test_language_odd_rows(spark):
    fields = [("doc_id", "long"), ("text", "string"), ("lang", "string"), ("ticket", "string"), ("turn", "string"), ("score", "string"), ("bits", "string")]
    schema = ", ".join(" ".join(f) for f in fields)
    rows = [
        (1, "the cat and the dog sit here", "en"), (1, "the cat and the dog sit here", "en"), (2, "le chat et le chien sont la", "fr"), (3, None, "fr"),
        (4, "", "en"), (5, "12 34 ²", "en"), (None, "the dog", None), (6, "ไทย", "fr"), (7, "the " * 300_000, None), (8, "x" * 300_000, None),
    ]
    docs = spark.createDataFrame([(*r, "t", "u", "v", "w") for r in rows], schema)
    got = language_id(docs, F.col("doc_id") < 6).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and sum(r.doc_id == 1 for r in got) == 2
    assert [by[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and by[3].score == 0
    assert by[1].lang_pred == "en" and by[2].lang_pred == "fr" and by[None].lang_pred == "en" and by[7].lang_pred == "en" and by[6].lang_pred in ("en", "fr")
    none = language_id(docs, F.lit(False)).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language_id(docs.limit(0), F.lit(True)).collect() == []


def plain_negatives(rows, scale=256):
    good = [(i, lab, [math.floor(scale * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, lab, v in good:
        if a % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), i, m) for i, m, w in good))
        for s, p, _ in [x for x in scored if x[2] == lab and x[1] != a][:5]:
            inside = [(i, t) for t, i, m in scored if m != lab and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a, p, k + 1, i, -s, -t) for k, (i, t) in enumerate(inside)]
    return sorted(out)


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "p", "a") for r in rows], f"vec_id long, label int, embedding array<{kind}>, pack string, anchor string")


@pytest.mark.parametrize("dims", [1, 3, 64, 100])
def test_negatives_equal_a_plain_search(spark, dims, monkeypatch):
    monkeypatch.setattr(hard, "PACK", 64 * dims)
    monkeypatch.setattr(hard, "ANCHOR_PACK", 64 * dims)
    rng = np.random.default_rng(dims)
    centres = rng.standard_normal((4, dims))
    rows = [(i, int(i % 4), [float(x) for x in np.float32(centres[(i // 7) % 4] + 0.5 * rng.standard_normal(dims))]) for i in range(700)]
    got = sorted(tuple(r) for r in hard_negatives(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect())
    assert got == plain_negatives(rows) and (got or dims > 3)


def test_intervals_hold_every_product():
    rng = np.random.default_rng(3)
    for dims in (1, 2, 63, 64, 130):
        rows, anchors = np.floor(256 * rng.standard_normal((200, dims))), np.floor(256 * rng.standard_normal((17, dims)))
        rows[:5], anchors[0] = 0, 0
        rows[5:10] = anchors[1]
        low, high = hard.intervals(*hard.encode(rows, 4), np.sqrt((rows * rows).sum(axis=1)), anchors)
        true = rows @ anchors.T
        assert (low <= true).all() and (true <= high).all()


def test_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    base = [(i, i % 2, [float(i % 5), 1.0, -0.25 * (i % 3)]) for i in range(40)]
    odd = [(41, None, [1.0, 1.0, 1.0]), (42, 1, None), (43, 1, [1.0, None, 1.0]), (44, 1, [nan, 1.0, 1.0]), (45, 1, [inf, 1.0, 1.0]), (None, 0, [1.0, 1.0, 1.0])]
    ties = [(100, 0, [1.0, 1.0, 0.0]), (101, 0, [1.0, 1.0, 0.0]), (102, 1, [0.5, 0.5, 0.0]), (103, 1, [0.5, 0.5, 0.0])]
    rows = base + odd + ties
    at = F.col("vec_id") % 100 == 0
    got = sorted(tuple(r) for r in hard_negatives(vectors(spark, rows, "double"), at).collect())
    assert got == plain_negatives(rows) and got
    assert hard_negatives(vectors(spark, rows, "double"), F.lit(False)).collect() == []
    assert hard_negatives(vectors(spark, [], "double"), at).collect() == []
    alone = [(0, 1, [1.0]), (1, 2, [1.0])]
    assert hard_negatives(vectors(spark, alone, "double"), at).collect() == []
    # Repeated rows count as often as they stand, shorter vectors end in zeros, an empty one scores 0.
    twice = [(0, 0, [1.0, 0.0])] * 2 + [(1, 0, [1.0, 0.0]), (2, 1, [0.5]), (2, 1, [0.5]), (3, 1, [])]
    full = [(i, lab, v + [0.0] * (2 - len(v))) for i, lab, v in twice]
    got = sorted(tuple(r) for r in hard_negatives(vectors(spark, twice, "double"), at).collect())
    assert got == plain_negatives(full) and len(got) == 4
    # Scores beyond what doubles hold exactly.
    big = [(0, 0, [1e9, 1.0]), (1, 0, [1e5, 1.0]), (2, 1, [5e4, 0.5]), (3, 1, [5e4, 0.25])]
    assert sorted(tuple(r) for r in hard_negatives(vectors(spark, big, "double"), at).collect()) == plain_negatives(big)


def test_schemas(spark):
    from tempora.llm.queries import op12_language_string_kernel, op13_hard_negatives_one_bit
    assert {f.name: f.dataType for f in op13_hard_negatives_one_bit(spark, FOLDER).schema} == {
        "anchor_id": T.LongType(), "positive_id": T.LongType(), "rank": T.IntegerType(), "negative_id": T.LongType(), "positive_score": T.LongType(), "negative_score": T.LongType()}
    assert dict(op12_language_string_kernel(spark, FOLDER).dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
