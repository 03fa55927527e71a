"""The pipeline's stages, each against a plain version of itself on the rows that the stage before it kept."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tempora.llm import oracles
from tempora.llm.sharding import shard

from tests.llm.test_results import jaccard_components

ITEM = "A tank of 300 l is filled by a pump at 25 l every minute, so how many minutes does the pump need to fill the whole tank?"
SOURCES = ["web", "books", None, "code"]
rng = random.Random(23)


def prose(n):
    return " ".join(f"word{rng.randint(0, 5000)}" for _ in range(n))


def edited(text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"edit{rng.random()}"
    return " ".join(w)


def documents():
    """(doc_id, text, lang, source): near and exact copies, repeated and null ids, equal rows, questions, junk."""
    rows = [(i, prose(rng.randint(60, 120)), "en" if i % 2 else "de", SOURCES[i % 4]) for i in range(700)]
    rows += [(1000 + i, edited(rows[i][1], 1), "en", "web") for i in range(60)]
    rows += [(1100 + i, rows[i][1], "en", "web") for i in range(30)]
    rows += [(5, "junk", "en", "web"), (5, prose(90), "en", "books"), (6, "$ " * 70, "de", "web"), rows[7], rows[7], rows[8]]
    rows += [(None, prose(80), "en", SOURCES[i % 4]) for i in range(20)] + [(None, "short text", "en", "web"), (None, None, "en", None), (None, "", "de", "web")]
    rows += [(None, rows[9][1], "en", "web"), (None, f"{prose(60)} {ITEM} {prose(20)}", "en", "web")] * 2
    other = ITEM.replace("300", "480").replace("25", "40")
    return rows + [(2000, f"{prose(60)} {ITEM}", "en", "web"), (2001, f"{other} {prose(70)}", "de", "books"), (2000, prose(75), "en", "web")]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows of the input and of every stage."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = documents()
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 50 != 1), 0) for i in range(700)] + [(None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), [sorted(map(repr, map(tuple, [(*r, len(r[1] or "")) for r in rows])))]
    out = [docs.collect()]
    assert sorted(map(repr, map(tuple, out[0]))) == kept[0]
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        after = step(spark, docs, folder)
        after.write.parquet(f"{folder}/stage{k}.parquet")
        assert k == 4 or after.columns == docs.columns
        docs = spark.read.parquet(f"{folder}/stage{k}.parquet")
        out.append(docs.collect())
    return folder, out


def test_quality_judges_rows_by_their_text(stages):
    folder, out = stages
    con = duckdb.connect()
    # SQL knows documents by doc_id, so every row gets a number, and labels follow it.
    con.sql(f"CREATE VIEW numbered AS SELECT row_number() OVER () AS n, * FROM '{folder}/documents.parquet/*.parquet'")
    con.sql("CREATE TABLE fixed AS SELECT * FROM numbered")
    con.sql("CREATE VIEW documents AS SELECT n AS doc_id, text, lang, source, n_chars FROM fixed")
    con.sql(f"CREATE VIEW labels AS SELECT f.n AS doc_id, l.quality, l.toxic FROM fixed f JOIN '{folder}/labels.parquet/*.parquet' l USING (doc_id)")
    want = con.sql(f"SELECT f.doc_id, f.text, f.lang, f.source, f.n_chars FROM fixed f JOIN ({oracles.QUALITY}) v ON f.n = v.doc_id WHERE v.kept").fetchall()
    assert Counter(map(tuple, out[1])) == Counter(want) and 0 < len(want) < len(out[0])
    assert not any(r.text in ("junk", "short text", "", None) for r in out[1]) and sum(r.doc_id is None for r in out[1]) == 24


def test_one_row_of_each_group_of_near_duplicates_stays(stages):
    before, after = stages[1][1], stages[1][2]
    # Numbers in order of doc_id, null last, stand for the rows.
    ordered = sorted(before, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    root = jaccard_components([(i, r.text) for i, r in enumerate(ordered)], 80)
    groups = {}
    for i, r in enumerate(ordered):
        groups.setdefault(root[i], []).append(r)
    assert len(after) == len(groups) < len(before)
    left = Counter(map(tuple, after))
    assert max(left.values()) == 1
    for members in groups.values():
        stays = [r for r in set(map(tuple, members)) if r in left]
        assert len(stays) == 1 and stays[0][0] == members[0].doc_id


def test_questions_go_with_the_row_that_holds_them(stages):
    before, after = stages[1][2], stages[1][3]
    clean = [tuple(r) for r in before if "so how many minutes does the pump need" not in r.text]
    assert Counter(map(tuple, after)) == Counter(clean) and len(before) - len(clean) == 3


def test_mix_keeps_budget_and_proportions(stages):
    before, after = stages[1][3], stages[1][4]
    size = lambda rows: sum(len(r.text.split()) for r in rows)
    total = size(before)
    assert 1.5 * total - 130 <= size(after) <= 1.5 * total
    count, held = Counter(map(tuple, after)), Counter(map(tuple, before))
    assert all(n <= 2 * held[r] for r, n in count.items())
    by = {s: (size([r for r in before if r.source == s]), size([r for r in after if r.source == s])) for s in SOURCES}
    # Weights 3, 1, 2, 3 in code point order, null last; what a source gives at most is twice its size.
    weight, most, target = {"books": 3, "code": 1, "web": 2, None: 3}, {s: 2 * by[s][0] for s in SOURCES}, {}
    rest = 1.5 * total
    while len(target) < 4:
        level = rest / sum(weight[s] for s in SOURCES if s not in target)
        full = [s for s in SOURCES if s not in target and weight[s] * level > most[s]]
        for s in full or [s for s in SOURCES if s not in target]:
            target[s] = most[s] if full else weight[s] * level
            rest -= target[s]
    assert all(abs(by[s][1] - target[s]) <= 260 for s in SOURCES), (by, target)


def test_every_row_of_the_mix_gets_a_slot(stages):
    before, after = stages[1][4], stages[1][5]
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
    slots = {}
    for r in after:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1 and len(after) == sum(sizes)


def test_common_passages_pull_documents_together(spark):
    passages = [prose(60) for _ in range(200)]
    rows = [(i, f"{prose(30)} {passages[i % 200]} {prose(20)}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def together(count):
        where = {r.doc_id: r.shard for r in shard(docs, shards=10, passages=count).select("doc_id", "shard").collect()}
        assert max(Counter(where.values()).values()) == min(Counter(where.values()).values()) == 200
        return sum(where[i] == where[j] for i in range(2000) for j in range(i + 200, 2000, 200)) / (200 * 45)

    assert together(0) < 0.2 and together(4) > 0.6


def test_row_keys_keep_the_order_of_ids(spark):
    ids = [-(2**63), -5, -1, 0, 1, 9, 10, 2**63 - 1, None]
    keys = [r["__row"] for r in corpus_pipeline.keyed(spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string")).collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(ids)
    rows = [(1, None, None), (1, "", None), (1, None, "s"), (1, "null", None), (1, None, "null"), (2, None, None)]
    got = corpus_pipeline.keyed(spark.createDataFrame(rows, "doc_id long, text string, source string")).select(F.countDistinct("__row")).first()[0]
    assert got == len(rows)
