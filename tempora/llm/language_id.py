"""Language identification by a string kernel.

The kernel of two texts is the number of letter n-grams (1 to LONGEST letters, word ends marked) that
both hold, over the root of the product of their numbers: a blended spectrum of presences.  Landmark
documents of every language span the Nyström space; one-versus-rest ridge regression in it is fitted
from the kernel's sums of squares, which every part of the training sample adds up on its own.
Scores of a batch of texts are X (B' a): X the presences, B those of the landmarks, a the dual
weights.  Products are associative, so B' a is multiplied once.

n-grams are hashed to WIDTH columns, so landmarks, weights and a batch have a known size whatever the
alphabet.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import stage

#: n-grams have up to LONGEST letters and fall into WIDTH columns.
LONGEST, WIDTH = 5, 1 << 18
#: Bounds per language: landmarks, and training rows in all (by a hash of doc_id and text).
LANDMARKS, SAMPLE = 64, 2000
RIDGE = 1e-3
#: Landmarks have that many characters if enough rows do; a text of a few words spans little.
TELLING = 300
#: Texts multiplied at once.
BATCH = 64
UNKNOWN = "und"


@functools.cache
def kinds() -> np.ndarray:
    """For every code point 2 for a letter, 1 for a mark, 0 for all else."""
    kind = {"L": 2, "M": 1}
    return np.array([kind.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.uint8)


def columns_of(text: str | None) -> np.ndarray:
    """Columns of the n-grams of a text's distinct words, repeats possible; none if it has no letter."""
    distinct = " ".join(set((text or "").lower().split()))
    points = np.frombuffer(f" {distinct} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[points]
    if not (kind == 2).any():
        return np.empty(0, np.uint32)
    points = np.where(kind > 0, points, np.uint32(32))
    gap = points == 32
    points = points[~gap | np.concatenate(([True], ~gap[:-1]))]
    gap, hashes, found = points == 32, np.zeros(len(points), np.uint32), []
    # A gap may begin or end an n-gram, but not lie within.
    whole = np.ones(len(points), bool)
    for n in range(1, min(LONGEST, len(points)) + 1):
        last = points[n - 1 :]
        hashes = (hashes[: len(last)] ^ last) * np.uint32(0x9E3779B1)
        hashes ^= hashes >> np.uint32(15)
        if n > 2:
            whole = whole[: len(last)] & ~gap[n - 2 : n - 2 + len(last)]
        found.append(hashes[whole[: len(last)] & ~gap] if n == 1 else hashes[whole[: len(last)]])
    return (np.concatenate(found) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - WIDTH.bit_length() + 1)


def products(found: list[np.ndarray], place: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """0/1 rows over the columns that ``place`` names, times ``factor``, over the root of their sums.

    ``factor`` has one more row, of zeros for the columns without a place, and ends with a column of ones.
    """
    x = np.zeros((len(found), len(factor)), np.float32)
    for row, columns in zip(x, found, strict=True):
        row[place[columns]] = 1
    out = x @ factor
    return out[:, :-1] / np.sqrt(np.maximum(out[:, -1:], 1))


def factor_of(weights: np.ndarray) -> np.ndarray:
    """``weights`` as ``products`` takes them."""
    out = np.ones((len(weights) + 1, weights.shape[1] + 1), np.float32)
    out[:-1, :-1], out[-1] = weights, 0
    return out


@dataclass
class Kernel:
    """Learned languages in code-point order, the used columns and their weights."""

    languages: list[str] = field(default_factory=list)
    place: np.ndarray | None = None
    weights: np.ndarray | None = None


def training_sample(docs: DataFrame, train: Column, sample: int) -> DataFrame:
    """lang, text, ticket of at most ``sample`` distinct rows a language, those of the least tickets."""
    known = docs.where(train & F.col("lang").isNotNull() & F.regexp_like("text", F.lit(r"\p{L}")))
    known = known.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id", "text").alias("ticket"))
    order = Window.partitionBy("lang").orderBy("ticket")
    picked = known.select("lang", "ticket").distinct().withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= sample).drop("turn")
    # At most ``sample`` numbers a language.
    return stage(known.join(F.broadcast(stage(picked)), ["lang", "ticket"]).groupBy("lang", "ticket").agg(F.first("text").alias("text")))


def landmarks(rows: DataFrame, count: int) -> tuple[list[str], np.ndarray]:
    """Language and packed presences of ``count`` landmarks a language: WIDTH / 8 bytes each."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = []
            for text in batch["text"]:
                row = np.zeros(WIDTH, np.uint8)
                row[columns_of(text)] = 1
                bits.append(np.packbits(row).tobytes())
            yield pd.DataFrame({"lang": batch["lang"], "ticket": batch["ticket"], "bits": bits})

    order = Window.partitionBy("lang").orderBy(F.length("text") < TELLING, "ticket")
    chosen = rows.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= count)
    found = sorted((r.lang, r.ticket, bytes(r.bits)) for r in chosen.select("lang", "ticket", "text").mapInPandas(work, "lang string, ticket long, bits binary").collect())
    return [r[0] for r in found], np.frombuffer(b"".join(r[2] for r in found), np.uint8).reshape(len(found), WIDTH // 8)


def fit(docs: DataFrame, train: Column, count: int = LANDMARKS, sample: int = SAMPLE, ridge: float = RIDGE) -> Kernel:
    """Fits the kernel regression on the rows of ``docs`` (doc_id, text, lang) that ``train`` picks.

    ``lang`` takes a moderate number of values; null ones, and texts without a letter, teach nothing.
    """
    rows = training_sample(docs, train, sample)
    of, bits = landmarks(rows, count)
    languages = sorted(set(of))
    if not languages:
        return Kernel()
    some = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits, axis=0)))
    place = np.full(WIDTH, len(some), np.int32)
    place[some] = np.arange(len(some))
    shared = docs.sparkSession.sparkContext.broadcast((bits, some, place))

    def spread() -> np.ndarray:
        bits, some, _ = shared.value
        base = np.empty((len(bits), len(some)), np.float32)
        for i, row in enumerate(bits):
            base[i] = np.unpackbits(row)[some]
            base[i] /= np.sqrt(max(1, base[i].sum()))
        return base

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, place = spread(), shared.value[2]
        factor = factor_of(base.T)
        square, cross, n = np.zeros((len(base), len(base))), np.zeros((len(base), len(languages))), 0
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at : at + BATCH]
                k = products([columns_of(t) for t in part["text"]], place, factor).astype(np.float64)
                y = (part["lang"].to_numpy()[:, None] == np.array(languages, object)[None]).astype(np.float64)
                square, cross, n = square + k.T @ k, cross + k.T @ y, n + len(part)
        yield pd.DataFrame({"n": [n], "square": [square.tobytes()], "cross": [cross.tobytes()]})

    # At most 8 rows of (landmarks + languages) x landmarks numbers, however many files the sample was written to.
    sums = rows.coalesce(8).mapInPandas(work, "n long, square binary, cross binary").collect()
    base = spread()
    m = len(base)
    square = sum(np.frombuffer(r.square).reshape(m, m) for r in sums)
    cross = sum(np.frombuffer(r.cross).reshape(m, -1) for r in sums)
    rows_seen = sum(r.n for r in sums)
    within = (base @ base.T).astype(np.float64)
    dual = np.linalg.lstsq(square + ridge * rows_seen * within + 1e-9 * rows_seen * np.eye(m), cross, rcond=None)[0]
    weights = (base.T @ dual).astype(np.float32)
    shared.unpersist()
    return Kernel(languages, place, weights)


def identify(docs: DataFrame, kernel: Kernel) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row.

    Whole texts are read.  A null text, one without a letter, and any text if nothing was learned, is
    ``und`` with score 0.  A text of unknown letters only gets the first language; so do ties, in
    code-point order.  Repeated rows are scored alike, null doc_ids stay, and an empty table gives an
    empty result.  Columns other than doc_id and text are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((kernel.languages, kernel.place, kernel.weights))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages, place, weights = shared.value
        factor = factor_of(weights) if languages else None
        for batch in batches:
            names, scores = [], []
            for at in range(0, len(batch), BATCH):
                found = [columns_of(t) for t in batch["text"].iloc[at : at + BATCH]]
                if languages:
                    raw = products(found, place, factor)
                    best = np.argmax(np.round(raw, 6), axis=1)
                for i, f in enumerate(found):
                    known = len(f) and languages
                    names.append(languages[best[i]] if known else UNKNOWN)
                    scores.append(round(float(min(1, max(0, raw[i, best[i]]))), 6) if known else 0.0)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": names, "score": np.array(scores, np.float64)})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(work, f"doc_id {kind}, lang_pred string, score double")


def language_id(docs: DataFrame, train: Column, count: int = LANDMARKS, sample: int = SAMPLE, ridge: float = RIDGE) -> DataFrame:
    """Learns from the rows that ``train`` picks and identifies all; see ``fit`` and ``identify``."""
    return identify(docs, fit(docs, train, count, sample, ridge))
