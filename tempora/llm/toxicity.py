"""Toxicity categories predicted in a chain.

The first category's linear model sees the stems of a text's words; every later one also sees the
probabilities of the categories before it.  While the chain is trained these probabilities come
from models that have not seen the document (out of fold), as they will not have seen the
documents to score; the same predictions choose each category's threshold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import stage

#: Most labelled documents that a chain is fitted on, most stems that it knows, and folds.
SAMPLE, VOCABULARY, FOLDS = 10_000, 1 << 16, 3
#: Documents of a partition while fitting.  Every step of every fit is a job over all partitions, and the driver
#: keeps a record of each task, so their number follows the sample and not the cluster's shuffle partitions.
PART = 2_500
#: A word that every text has, so that there is a vocabulary whatever the texts are.
ALWAYS = "\u0001"
STEMS = (4, 5)
GRID = tuple(round(0.05 * i, 2) for i in range(1, 20))


@dataclass
class Chain:
    """Fitted models of the categories, in order; none at all if there was too little to learn from."""

    categories: Sequence[str]
    words: CountVectorizerModel | None = None
    models: list[LogisticRegressionModel] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)


def _starts(found: Column, n: int) -> Column:
    return F.transform(found, lambda w: F.substring(w, 1, n))


def terms(text: Column) -> Column:
    """The beginnings, four and five letters long, of lower-case runs of letters: stems without their endings."""
    found = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+"))
    return F.concat(F.array(F.lit(ALWAYS)), F.array_distinct(F.concat(*[_starts(found, n) for n in STEMS])))


def sized(df: DataFrame, column: str, n: int) -> DataFrame:
    """States the length of a vector column in place of a list of its attributes, which would go out with every job that reads it."""
    return df.withColumn(column, F.col(column).alias(column, metadata={"ml_attr": {"num_attrs": n}}))


def with_words(df: DataFrame, words: CountVectorizerModel) -> DataFrame:
    """Replaces __terms by __words, the vector of the stems that a row has."""
    return sized(words.transform(df).drop("__terms"), "__words", len(words.vocabulary))


def with_inputs(df: DataFrame, before: Sequence[str], words: CountVectorizerModel) -> DataFrame:
    """Adds __inputs: the word vector and the probabilities of the categories before."""
    joined = VectorAssembler(inputCols=["__words", *[f"p_{c}" for c in before]], outputCol="__inputs").transform(df)
    return sized(joined, "__inputs", len(words.vocabulary) + len(before))


def predict(df: DataFrame, model: LogisticRegressionModel, category: str) -> DataFrame:
    """Adds p_<category>; needs __inputs, which goes."""
    scored = model.transform(df)
    p = F.element_at(vector_to_array("__probability"), 2) if model.numClasses > 1 else F.lit(0.0)
    return scored.withColumn(f"p_{category}", p).drop("__inputs", "__probability", "__raw", "__guess")


def train(df: DataFrame, category: str, reg: float, rounds: int) -> LogisticRegressionModel:
    return LogisticRegression(
        featuresCol="__inputs", labelCol=category, probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__guess",
        family="binomial", elasticNetParam=1.0, regParam=reg, maxIter=rounds,
    ).fit(df)


def best_threshold(df: DataFrame, category: str) -> float:
    """The threshold of the grid with the best F1 score."""
    p, y = F.col(f"p_{category}"), F.col(category) == 1
    sums = df.agg(*[F.sum(F.when(p >= t, F.when(y, 2).otherwise(1)).otherwise(0)).alias(f"hit_{i}") for i, t in enumerate(GRID)],
                  *[F.sum(((p >= t) & y).cast("int")).alias(f"right_{i}") for i, t in enumerate(GRID)], F.sum(y.cast("int")).alias("all")).first()
    f1 = [2 * sums[f"right_{i}"] / max(1, sums[f"hit_{i}"] - sums[f"right_{i}"] + sums["all"]) for i in range(len(GRID))]
    return GRID[max(range(len(GRID)), key=lambda i: (f1[i], -abs(GRID[i] - 0.5)))]


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE, folds: int = FOLDS, reg: float = 0.001, rounds: int = 25) -> Chain:
    """Fits a chain on at most ``sample`` labelled documents, chosen by a hash of doc_id.

    ``labels`` has doc_id and a 0/1 column per category; rows with a null are left out, repeated
    doc_ids count once, as 1 where any label says so.
    """
    known = labels.dropna(subset=["doc_id", *categories]).groupBy("doc_id").agg(*[F.max(c).cast("double").alias(c) for c in categories])
    turn = F.xxhash64("doc_id", F.lit("sample"))
    # Labels of documents that are not there would use up the sample.
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = known.orderBy(turn, "doc_id").limit(sample)
    picked = stage(picked.withColumn("__fold", F.row_number().over(Window.orderBy(turn, "doc_id")) % folds))
    if picked.count() < 2 * folds:
        return Chain(categories)
    # At most ``sample`` rows of a few numbers.
    d = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
    d = stage(d.select("doc_id", "__fold", *categories, terms(F.col("text")).alias("__terms")).repartition(folds * 4, "doc_id"))
    words = CountVectorizer(inputCol="__terms", outputCol="__words", vocabSize=VOCABULARY, minDF=float(max(1, min(10, d.count() // 50))), binary=True).fit(d)
    parts = -(-sample // PART)
    d = stage(with_words(d, words)).coalesce(parts).cache()
    chain = Chain(categories, words)
    for k, category in enumerate(categories):
        inputs = with_inputs(d, categories[:k], words).cache()
        unseen = None
        for fold in range(folds):
            model = train(inputs.where(F.col("__fold") != fold), category, reg, rounds)
            part = predict(inputs.where(F.col("__fold") == fold), model, category)
            unseen = part if unseen is None else unseen.union(part)
        chain.models.append(train(inputs, category, reg, rounds))
        nxt = stage(unseen).coalesce(parts).cache()
        chain.thresholds.append(best_threshold(nxt, category))
        inputs.unpersist()
        d.unpersist()
        d = nxt
    d.unpersist()
    return chain


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, p_<category> and is_<category> for every row.

    ``docs`` needs doc_id and text; other columns are ignored.  Null and empty texts are scored as
    texts without words.  Repeated rows are scored alike.  A chain that had too few labels to learn
    from gives null probabilities and false verdicts.
    """
    if chain.words is None:
        return docs.select("doc_id", *[F.lit(None).cast("double").alias(f"p_{c}") for c in chain.categories], *[F.lit(False).alias(f"is_{c}") for c in chain.categories])
    d = with_words(docs.select("doc_id", terms(F.col("text")).alias("__terms")), chain.words)
    for k, (category, model) in enumerate(zip(chain.categories, chain.models, strict=True)):
        d = predict(with_inputs(d, chain.categories[:k], chain.words), model, category)
    return d.select("doc_id", *[f"p_{c}" for c in chain.categories], *[(F.col(f"p_{c}") >= t).alias(f"is_{c}") for c, t in zip(chain.categories, chain.thresholds, strict=True)])


def toxicity(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("low_quality", "toxic")) -> DataFrame:
    """Fits a chain on labelled documents and scores all of them."""
    return score(docs, fit(docs, labels, categories))
