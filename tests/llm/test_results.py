"""Operators against plain versions of themselves."""

import hashlib
import math
import random
import time
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tempora.llm import near_duplicates, queries
from tempora.llm.decontamination import decontaminate
from tempora.llm.line_chunks import dedup_line_chunks
from tempora.llm.near_duplicates import shingle_set
from tempora.llm.pseudonyms import digits_of, feistel, kind_of, pseudonym, pseudonymise, refill
from tempora.llm.quality import binomial_at_most
from tempora.llm.repeated_bytes import remove_repeated_bytes
from tempora.llm.sharding import shard
from tempora.llm.token_counts import PIECES, Counter as TokenCounter, read_pieces
from tempora.llm.toxicity import fit, score

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(theirs.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (mine, theirs))
    assert a.equals(b)


def test_binomial_tail(spark):
    cases = [(0, 10), (3, 200), (7, 1000), (0, 1), (40, 5000), (12, 600)]
    d = spark.createDataFrame(cases, "k long, n long").select("*", binomial_at_most(F.col("k").cast("double"), F.col("n").cast("double"), 0.02).alias("p"))
    for k, n, p in d.collect():
        exact = sum(math.comb(int(n), j) * 0.02**j * 0.98 ** (int(n) - j) for j in range(int(k) + 1))
        assert p == pytest.approx(exact if k < n * 0.02 else 1.0, rel=1e-9)


def test_token_counts_are_the_librarys():
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = read_pieces(PIECES)
    t = Tokenizer(models.Unigram([("<unk>", min(s for _, s in pieces)), *pieces], 0, False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng, count = random.Random(1), TokenCounter(pieces)
    texts = ["", " ", "  a", "▁", *("".join(rng.choice("ab ▁\n中é\U0001f600the ing 0#") for _ in range(rng.randint(0, 60))) for _ in range(2000))]
    texts += [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]
    assert [count.text(x) for x in texts] == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_pseudonyms_are_permutations_of_their_format(spark):
    four = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("v"))
    mapped = four.select(refill(F.col("v"), feistel(digits_of(F.col("v"), "0123456789"), 10, "k", "t"), "0123456789").alias("p"))
    assert mapped.distinct().count() == 10_000
    days = spark.range(73_049).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("v"))
    got = days.select(pseudonym(F.col("v"), F.lit("date"), "k").alias("p")).agg(F.countDistinct("p"), F.min("p"), F.max("p")).first()
    assert tuple(got) == (73_049, "1900-01-01", "2099-12-31")


def test_pseudonyms_link_equal_values_and_leave_the_rest(spark):
    rows = [(1, "card 7536784127813050, bad 9807915762804490, 300.1.1.1 and 1999-02-30"), (2, "7536784127813050 at 97.51.17.173 on 28.02.1999; 1999-02-28"), (3, "A.97@mail1.example.com +1 (974) 555-3436 97.51.17.173")]
    d = {r.doc_id: r for r in pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    card = re.search(r"card (\d{16})", d[1].text)[1]
    assert card != "7536784127813050" and d[2].text.startswith(card + " at ")
    assert "9807915762804490" in d[1].text and "300.1.1.1" in d[1].text and "1999-02-30" in d[1].text
    ip = re.search(r"at (\S+) on", d[2].text)[1]
    assert ip != "97.51.17.173" and d[3].text.endswith(ip) and all(0 <= int(x) < 256 for x in ip.split("."))
    day = re.search(r"on (\d\d)\.(\d\d)\.(\d{4}); (\d{4})-(\d\d)-(\d\d)", d[2].text).groups()
    assert day[:3] == day[:2:-1] and day[2] != "1999"
    assert re.fullmatch(r"[a-z]\.\d\d@mail1\.example\.com \+1 \(\d{3}\) \d{3}-\d{4} \S+", d[3].text)
    assert (d[1].n_card, d[2].n_date, d[3].n_phone, d[3].n_email, d[3].n_address) == (1, 2, 1, 1, 1)
    valid = spark.createDataFrame([(card,)], "v string").select(kind_of(F.col("v"))).first()[0]
    assert valid == "card"


def test_reparameterised_questions_are_caught(spark):
    item = "the farmer Smith sold 12 kg of apples to Jones and then Smith bought 12 kg of pears from the market"
    rows = [
        (1, item), (2, "So: " + item.replace("Smith", "Brown").replace("12", "345").replace("kg", "lb") + "!"),
        (3, item.replace("12 kg of apples", "7 kg of apples")),  # 12 would stand for 7 and for 12
        (4, "the farmer sold apples"), (5, item.upper().replace(" ", "!! ")), (6, "completely other words that share nothing with any question at all here"),
    ]
    got = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in got if r.contaminated} >= {1, 2, 5} and not {4, 6, 3} & {r.doc_id for r in got if r.contaminated}


ITEMS = {
    "a": "A train leaves Boston at 9 and reaches New York at 13 after 340 km. How fast does the train go between Boston and New York on average?",
    "b": "Natalia sold clips to 48 of her friends in April and then she sold half as many clips in May. How many clips did Natalia sell in April and May?",
    "c": "3 17 24 5 98 61 12 45 77 20 31 8",
}


def shapes_of(text):
    w = text.split()
    yield from (text, text.lower(), text.upper())
    for n in (3, 8, 9):
        yield "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))


def test_copies_in_any_case_and_with_any_line_breaks(spark):
    rows, want = [], {}
    for item, text in ITEMS.items():
        for shape in shapes_of(text):
            want[len(rows)] = item
            rows.append((len(rows), f"Some words come before it. {shape} And some after that"))
    clean = [
        "The train from Boston was late and nobody in New York knew how fast it would go between the two", " ".join(map(str, range(100, 400))),
        "Natalia sold her house in May and moved to the sea with 48 of her books and half as many plants",
        # The template of an item, one of whose names stands for two others.
        ITEMS["b"].replace("April and May", "June and July"),
    ]
    other = ITEMS["b"].replace("Natalia", "Marta").replace("April", "June").replace("May", "July").replace("48", "96")
    rows += [(100 + i, t) for i, t in enumerate(clean)] + [(200, f"So: {other}")]
    bench = spark.createDataFrame([*ITEMS.items(), (None, "one item that has no name but as many words as it takes to be found"), ("a", ITEMS["a"]), ("d", None)], "item_id string, text string")
    rows.append((300, "one item that has no name but as many words as it takes to be found"))
    got = {r.doc_id: r for r in decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert {i: got[i].item_ids for i in want} == {i: [item] for i, item in want.items()}
    assert not any(got[100 + i].contaminated for i in range(4)) and got[200].item_ids == ["b"]
    assert got[300].contaminated and got[300].item_ids == [] and len(got) == len(rows)


def test_tables_of_numbers_meet_in_few_rows(spark):
    numbers = " ".join(str(i % 991) for i in range(20_000))
    same = "7 " * 20_000
    bench = spark.createDataFrame([(1, " ".join(str(3 * i) for i in range(200))), (2, "7 " * 200)], "item_id long, text string")
    decontaminate(spark.createDataFrame([(0, "warm up")], "doc_id long, text string"), bench).collect()
    began = time.time()
    got = {r.doc_id: r.item_ids for r in decontaminate(spark.createDataFrame([(1, numbers), (2, same), (3, "x " + "7 " * 20)], "doc_id long, text string"), bench).collect()}
    assert got == {1: [], 2: [2], 3: [2]} and time.time() - began < 20


def jaccard_components(rows, percent):
    """Every document's least connected doc_id, by comparing all pairs."""
    sets, root = {i: set(shingle_set(t, 5).tolist()) for i, t in rows}, {i: i for i, _ in rows}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and root[i] != root[j] and 100 * len(a & b) >= percent * len(a | b):
                root = {k: min(root[i], root[j]) if r in (root[i], root[j]) else r for k, r in root.items()}
    return root


@pytest.mark.parametrize("length", [512, 40])
def test_an_original_links_its_light_edits(spark, monkeypatch, length):
    monkeypatch.setattr(near_duplicates, "SLICE", length)
    rng, rows = random.Random(11), []
    for family in range(3):
        base = [f"w{rng.randint(0, 9999)}" for _ in range(404)]
        for k in range(150):
            copy = list(base)
            for at in rng.sample(range(404), 0 if k == 77 else 4 if k < 130 else 9):  # J of 0.905 to the original, or below the threshold
                copy[at] = f"new{rng.random()}"
            rows.append((1000 * family + k, " ".join(copy)))
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = jaccard_components(rows, 85)
    assert {r.doc_id: r.component_id for r in got} == want and max(Counter(want.values()).values()) >= 130


def test_pipeline_drops_near_copies_from_80_percent(spark):
    words = [f"w{i}" for i in range(104)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:94], *(f"x{i}" for i in range(10))])), (3, " ".join([*words[:90], *(f"y{i}" for i in range(14))]))]  # 90 of 110, 86 of 114
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, SF).collect()) == [1, 3]


def test_sketches_refute_no_similar_pair():
    rng = random.Random(12)
    sets = []
    for n in (1, 5, 30, 31, 33, 250, 260, 2000):
        base = [rng.getrandbits(64) for _ in range(n)]
        sets += [np.unique(np.array([x if rng.random() < keep else rng.getrandbits(64) for x in base[: rng.randint((9 * n + 9) // 10, n)]], np.uint64)) for keep in (1, 1, 0.97, 0.93, 0.9, 0.8)]
    n = np.array([len(s) for s in sets])
    for percent in (40, 80, 85):
        got = {tuple(sorted(p)) for p in near_duplicates.possible(n, np.arange(len(n)), np.zeros(len(n)), [near_duplicates.sketch(s) for s in sets], percent)}
        want = {(i, j) for j in range(len(n)) for i in range(j) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= percent * (n[i] + n[j] - c)}
        assert want <= {(int(i), int(j)) for i, j in got} and want


def lines_of_passages(rows, longest_only):
    """Line numbers by document that lie in a run of lines equal to an earlier run, by a plain loop over pairs of places.

    With ``longest_only`` runs of more than 50 words, else those of two lines with words or 50 words."""
    places, found = {}, {}
    for d, t in rows:
        lines = t.split("\n")
        for k, x in enumerate(lines):
            for e, earlier, j in places.get(x, []):
                a = 0
                while k - a > 0 and j - a > 0 and lines[k - a - 1] == earlier[j - a - 1]:
                    a += 1
                z = 0
                while k + z + 1 < len(lines) and j + z + 1 < len(earlier) and lines[k + z + 1] == earlier[j + z + 1]:
                    z += 1
                run = lines[k - a : k + z + 1]
                words = sum(len(y.split()) for y in run)
                if words > 50 if longest_only else words >= 50 or sum(1 for y in run if y.split()) > 1:
                    found.setdefault(d, set()).add(k)
            places.setdefault(x, []).append((d, lines, k))
    return found


def repeated_passages():
    rng, rows, n = random.Random(3), [], 0

    def own(k, long=13):
        return [" ".join(f"w{rng.random()}" for _ in range(rng.randint(1, long))) for _ in range(k)]

    for size, long, copies in ((1, 60, 2), (1, 60, 5), (2, 30, 2), (2, 30, 9), (3, 18, 3), (4, 13, 2), (4, 13, 30), (5, 11, 2), (8, 8, 3), (12, 5, 2), (12, 13, 4), (60, 9, 2)):
        for _ in range(6):
            passage = [" ".join(f"p{rng.random()}" for _ in range(long)) for _ in range(size)]
            passage = passage if size < 4 or rng.random() < 0.5 else [*passage[:2], "", *passage[2:]]
            for _ in range(copies):
                rows.append((n, "\n".join([*own(rng.randint(0, 9)), *passage, *own(rng.randint(0, 9))])))
                n += 1
    stock = own(30)
    rows += [(n + k, "\n".join(["", *stock[(a := rng.randint(0, 25)) : a + rng.randint(0, 12)], *own(1), "", *rng.sample(stock, 2)])) for k in range(60)]
    return [*rows, (n + 70, "a b\nc\n" * 40), (n + 71, "\n" * 30), (n + 72, "\n" * 30), (n + 73, "x\n\ny"), (n + 74, "\n".join(own(50)))]


def test_line_chunks_against_a_loop(spark):
    rows = repeated_passages()
    must, may = lines_of_passages(rows, True), lines_of_passages(rows, False)
    got = {r.doc_id: r for r in dedup_line_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {d for d, _ in rows}
    hit = missed = 0
    for d, t in rows:
        # A line is gone where the left ones, matched greedily, skip one of the lines that may go.
        left, lines, gone = got[d].text.split("\n") if got[d].n_removed_lines < len(t.split("\n")) else [], t.split("\n"), set()
        k = 0
        for x in left:
            while lines[k] != x:
                gone.add(k)
                k += 1
            k += 1
        gone |= set(range(k, len(lines)))
        assert got[d].n_lines == len(lines) and len(gone) == got[d].n_removed_lines
        # Passages that adjoin are one, with blank lines beside them.
        assert Counter(lines[k] for k in gone if lines[k]) <= Counter(lines[k] for k in may.get(d, ())), d
        expected = Counter(lines[k] for k in must.get(d, ()))
        missed += (expected - Counter(lines[k] for k in gone)).total()
        hit += expected.total()
    # All planted passages are found; of the random cuts of one stock, an edge of two lines may equal another copy than the first.
    assert missed <= hit // 100 and hit > 1000


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 8])
def test_every_passage_of_over_50_words_goes_and_one_copy_stays(spark, size):
    rng = random.Random(size)
    words = -(-51 // size)
    rows, want = [], {}
    for k in range(0, 120, 2):
        passage = [" ".join(f"p{rng.random()}" for _ in range(words)) for _ in range(size)]
        for d in (k, k + 1):
            around = [[f"own {rng.random()}" for _ in range(3)] for _ in range(2)]
            rows.append((d, "\n".join(around[0] + passage + around[1])))
            want[d] = rows[-1][1] if d == k else "\n".join(around[0] + around[1])
    got = dedup_line_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == want


def test_repeated_bytes_against_a_loop(spark):
    rng, length = random.Random(5), 400
    base = ["".join(rng.choice("abcdefgh ñ") for _ in range(1500)) for _ in range(6)]
    rows = []
    for k in range(50):
        parts = [s[(a := rng.randint(0, 1000)) : a + rng.randint(100, 500)] + "xyz"[: rng.randint(0, 3)] for s in rng.choices(base, k=rng.randint(0, 3))]
        rows.append((k, "".join(parts)))
    rows += [(100, "a" * 900), (101, "ab" * 500), (102, None), (104, "b" * 400), (105, "b" * 399), (106, rows[3][1]), (7, rows[7][1]), (107, "abc" * 300 + "q" + "abc" * 300)]
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    want = []
    for d, b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not before for g, before in zip(gone, [False, *gone], strict=False))
        want.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    got = remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).drop("removed").collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(w[2] for w in want) > 5000


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_are_even_and_keep_groups(spark, law):
    rng = random.Random(2)
    rows = [(i, f"text {i} " + "x" * rng.randint(0, 200)) for i in range(1500)] + [(i, f"copy {i % 150}") for i in range(1500, 2000)] + [(i, "the same") for i in range(2000, 3000)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=10, law=law).collect()
    text = dict(rows)
    assert len(got) == len(rows) and all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id]) + 16 for r in got)
    slots, load, where = {}, Counter(), {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        load[r.shard] += r.size if law == "bytes" else 1
        where.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= (500 if law == "bytes" else 1)
    split = sum(len(w) > 1 for t, w in where.items() if t.startswith("copy"))
    assert split <= 20 and 4 <= len(where["the same"])  # a third of all rows does not fit into fewer


def test_chain_on_held_out_documents(spark):
    rng = random.Random(4)
    vocabulary = [f"{c}{v}rd{i}" for i in range(40) for c, v in (("w", "o"), ("b", "i"))]

    def make(i):
        bad, junk = rng.random() < 0.4, rng.random() < 0.4
        ws = rng.choices(vocabulary, k=30) + rng.choices(["viletext", "nastyone"], k=3) * bad + rng.choices(["spamlink", "clickbait"], k=3) * junk
        rng.shuffle(ws)
        return i, " ".join(ws), int(junk), int(bad or junk)

    rows = [make(i) for i in range(500)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], *r[2:]) for r in rows[:300]], "doc_id long, junk int, toxic int")
    chain = fit(docs, labels, ("junk", "toxic"), rounds=10)
    truth = {r[0]: r[2:] for r in rows}
    held = [r for r in score(docs, chain).collect() if r.doc_id >= 300]
    assert sum((r.is_junk, r.is_toxic) == tuple(map(bool, truth[r.doc_id])) for r in held) >= 0.95 * len(held)
    # The second model sees the first one's probability, by more than its words.
    assert chain.models[1].coefficients.size == chain.models[0].coefficients.size + 1
