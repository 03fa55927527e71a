"""Cases of the third review on documents: each failed before its finding was mended."""

from pyspark.sql import functions as F

from tempora.llm import toxicity
from tempora.llm.common import words
from tempora.llm.decontamination import window_hashes
from tempora.llm.sharding import SHINGLE, least_hashes


def test_window_hashes_work_each_width_out_once(spark):
    """pipeline: every width was written out wherever the next one named it, so a text was split 28 times."""
    texts = ["", "one", "a b c d", "a b c d e", "a b c d e a b c d e", "The cat sat on the mat and the dog sat by the door", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = words(F.lower("text"))
    plan = docs.select(least_hashes(F.col("text"), 4).alias("least"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1

    def pairs(h, by):
        return F.expr(f"transform(sequence(1, size({h}) - {by}), i -> xxhash64({h}[i - 1], {h}[i - 1 + {by}]))")

    for size, steps in ((SHINGLE, (1, 2, 1)), (8, (1, 2, 4))):
        long = docs.withColumn("w", found).where(F.size("w") >= size).withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
        for by in steps:
            long = long.withColumn("h", pairs("h", by))
        want = {r.doc_id: r.h for r in long.select("doc_id", "h").collect()}
        got = {r.doc_id: r.h for r in docs.select("doc_id", window_hashes(found, size).alias("h")).collect()}
        assert want and got == {i: want.get(i, []) for i in range(len(texts))}
    least = {r.doc_id: r.h for r in docs.select("doc_id", least_hashes(F.col("text"), 4).alias("h")).collect()}
    assert len(least[4]) == 4 and least[4] == sorted(least[4]) and least[1] == [] and least[6] == []


def test_chain_is_fitted_by_small_jobs(spark, monkeypatch):
    """op1: a name for every stem went out with every job of a fit, and the training rows lay in as many partitions as files were read."""
    train, seen = toxicity.train, []

    def watched(df, category, reg, rounds):
        seen.append((df.schema["__inputs"].metadata, df.rdd.getNumPartitions()))
        return train(df, category, reg, rounds)

    monkeypatch.setattr(toxicity, "train", watched)
    rows = [(i, " ".join(["vile"] * (i % 2) + ["spam"] * (i % 3 == 0) + [chr(97 + i % 26) * 3 + chr(97 + j) * 2 for j in range(20)])) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), i % 2) for i, _ in rows], "doc_id long, junk int, toxic int")
    chain = toxicity.fit(docs, labels, ("junk", "toxic"), rounds=5)
    n = len(chain.words.vocabulary)
    assert n > 300 and [m for m, _ in seen] == [{"ml_attr": {"num_attrs": n}}] * 4 + [{"ml_attr": {"num_attrs": n + 1}}] * 4
    assert max(parts for _, parts in seen) <= -(-toxicity.SAMPLE // toxicity.PART)
    got = {r.doc_id: (r.is_junk, r.is_toxic) for r in toxicity.score(docs, chain).collect()}
    assert got == {i: (i % 3 == 0, i % 2 == 1) for i, _ in rows}
