"""Nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables, for every operator."""

import pytest
from pyspark.sql import functions as F

from tempora.llm.decontamination import decontaminate
from tempora.llm.line_chunks import dedup_line_chunks
from tempora.llm.mixing import mix
from tempora.llm.near_duplicates import near_duplicates
from tempora.llm.pseudonyms import pseudonymise
from tempora.llm.quality import quality_rules
from tempora.llm.repeated_bytes import remove_repeated_bytes
from tempora.llm.sharding import shard
from tempora.llm.token_counts import token_counts
from tempora.llm.toxicity import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, size string, copies string, n_words string, vid string, label string, stratum string, ticket string, chunks string, n_email string"
LONG = " ".join(f"word{i % 977} item{i}" for i in range(20_000))
QUESTION = "a farmer keeps some hens and sells their eggs at the market every week"
TEXTS = [
    (1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, "one two three four five six seven"),
    (3, None), (4, ""), (5, " \n\t "), (None, "no id here"), (None, None), (6, LONG), (7, "line a\nline b\nline c\n" * 3), (8, f"Well. {QUESTION} indeed"),
]


def table(spark, rows):
    extra = ["x"] * (len(SCHEMA.split(",")) - 5)
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 4 else "s", 0, *extra) for i, t in rows], SCHEMA)


def operators(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, QUESTION, "x"), (2, None, "x"), (3, "", "x"), (4, "too short", "x")], "item_id long, text string, n string")
    return {
        "toxicity": lambda d: toxicity(d, labels.withColumn("low_quality", 1 - F.col("quality"))),
        "quality": lambda d: quality_rules(d, labels),
        "tokens": token_counts,
        "mix": mix,
        "pseudonyms": lambda d: pseudonymise(d, "k"),
        "decontaminate": lambda d: decontaminate(d, bench),
        "near": near_duplicates,
        "lines": dedup_line_chunks,
        "bytes": remove_repeated_bytes,
        "shard": shard,
    }


NAMES = ["toxicity", "quality", "tokens", "mix", "pseudonyms", "decontaminate", "near", "lines", "bytes", "shard"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, name):
    got = operators(spark)[name](table(spark, TEXTS)).collect()
    assert len(got) == len(TEXTS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    a, b = by[1]
    if name in ("quality", "near", "lines", "bytes", "tokens", "pseudonyms", "toxicity"):
        assert a == b
    if name == "toxicity":
        assert {r.is_toxic for r in got} == {False} and {r.p_toxic for r in got} == {None}
    if name == "quality":
        assert by[3][0].n_words == by[4][0].n_words == by[5][0].n_words == 0 and by[3][0].base_failed and not by[3][0].kept
        assert by[6][0].n_words == 40_000 and not by[6][0].base_failed
        assert by[7][0].n_dup_lines == 6 and by[7][0].n_repeat_words == 18
    if name == "tokens":
        assert by[3][0].n_tokens == by[4][0].n_tokens == 0 and by[6][0].n_tokens >= 40_000
    if name == "mix":
        assert by[3][0].taken == 0 and all(r.taken <= 2 * r.size for r in got) and by[4][0].source is None
        assert sum(r.taken for r in got) <= 1.5 * sum(r.size for r in got)
    if name == "pseudonyms":
        assert by[3][0].text is None and by[4][0].text == "" and by[6][0].text == LONG and by[1][0].n_email == "x" and by[1][0].n_email_found == 0
    if name == "decontaminate":
        assert [i for i, rows in by.items() if rows[0].contaminated] == [8] and by[8][0].item_ids == [1]
    if name == "near":
        assert by[2][0].component_id == 1 and not by[2][0].kept and a.kept
        assert by[3][0].n_shingles == by[4][0].n_shingles == by[5][0].n_shingles == 0 and by[3][0].component_id == 3
        assert all(r.component_id is None and r.kept for r in by[None]) and by[6][0].n_shingles > 35_000
    if name == "lines":
        assert by[3][0].text is None and by[4][0].text == "" and by[4][0].n_lines == 1 and by[6][0].text == LONG
    if name == "bytes":
        assert by[3][0].n_bytes == 0 and by[4][0].n_removed == 0 and by[6][0].n_bytes == len(LONG)
    if name == "shard":
        assert sorted(r.shard for r in got) == sorted(set(r.shard for r in got)) and {r.slot for r in got} == {0}
        assert by[3][0].size == by[4][0].size == 16 and by[3][0].text_crc32 is None and by[4][0].text_crc32 == 0


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert operators(spark)[name](table(spark, [])).collect() == []


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    good = " ".join(f"plain{i}" for i in range(80))
    rows = [*TEXTS, (9, good), (10, good + " more"), (11, " ".join(f"other{i}" for i in range(60)))]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, str(tmp_path))
        assert docs.columns == spark.read.parquet(f"{tmp_path}/documents.parquet").columns
    assert {r.doc_id for r in docs.collect()} <= {6, 9, 11}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count() > 0


def test_pseudonyms_of_a_million_characters(spark):
    texts = ["mail a@b" + ".c" * 500_000, "a." * 500_000 + "@b.c", "a@" * 400_000, "1" * 1_000_000, "f" * 1_000_000, "1.2." * 500, "+1 234 " * 500, "4111 " * 500]
    got = {r.doc_id: r for r in pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8), "k").collect()}
    assert all(len(got[i].text) == len(t) for i, t in enumerate(texts)) and got[0].n_email == 1 and got[3].text == texts[3]
