"""Hard negatives by rotated one-bit codes, deterministic intervals and exact integer scores.

Every vector is turned by one random rotation and coded as a sum of scaled sign vectors: the signs of
what is left, the alignment of those signs with it, and so on for LEVELS codes.  The inner product of
a code with an anchor, whose rotated components are quantised to PLANES bits, is a sum of popcounts,
one a bit plane.  What the codes leave open, r, is orthogonal to the last code x, so by
Cauchy-Schwarz |<r, q>| <= |r| sqrt(|q|^2 - <x, q>^2): an interval that surely holds the product.
A pair whose interval cannot reach the result is dropped, all others are scored by integers.

Anchors and vectors are dealt into packs; a cell is one pack of either, and all cells together are
the stated anchors against all vectors.  Every cell hands on its best few rows an anchor, which are
merged.  Anchors' positives come first, as their scores set the windows for the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import stage

#: Codes a vector, bits a quantised anchor component, seed of the rotation.
LEVELS, PLANES, SEED = 4, 8, 20240613
#: Components per pack of vectors and of anchors (a pack has that many over the dimension rows), and anchors scored at once.
PACK, ANCHOR_PACK, TILE = 1 << 19, 1 << 17, 32
SCALE = 256

CODED = "pack int, n int, ids binary, labels binary, dims int, vectors binary, codes binary, alignments binary, rest binary"


def rotation(dims: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))[0]


def encode(vectors: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows x levels x 64-bit words), alignments (rows x levels) and the norm of what is left."""
    n, dims = vectors.shape
    left = vectors @ rotation(dims).T
    words = -(-dims // 64)
    codes, alignments = np.empty((n, levels, words), np.uint64), np.empty((n, levels))
    for k in range(levels):
        up = left > 0
        bits = np.zeros((n, words * 64), np.uint8)
        bits[:, :dims] = up
        codes[:, k] = np.packbits(bits, axis=1).view(np.uint64)
        signs = np.where(up, 1.0, -1.0) / np.sqrt(dims)
        alignments[:, k] = (left * signs).sum(axis=1)
        left = left - alignments[:, k, None] * signs
    return codes, alignments, np.sqrt((left * left).sum(axis=1))


def intervals(codes: np.ndarray, alignments: np.ndarray, rest: np.ndarray, norms: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products, rows x anchors."""
    n, levels, words = codes.shape
    dims = anchors.shape[1]
    turned = anchors @ rotation(dims).T
    least, step = turned.min(axis=1), np.maximum(np.ptp(turned, axis=1), 1e-300) / (2**PLANES - 1)
    units = np.clip(np.rint((turned - least[:, None]) / step[:, None]), 0, 2**PLANES - 1)
    coded = least[:, None] + step[:, None] * units
    missed = np.sqrt(((turned - coded) ** 2).sum(axis=1))
    size = (coded * coded).sum(axis=1)
    bits = np.zeros((len(anchors), PLANES, words * 64), np.uint8)
    bits[:, :, :dims] = (units.astype(np.int64)[:, None, :] >> np.arange(PLANES)[:, None]) & 1
    planes = np.packbits(bits, axis=2).view(np.uint64)
    total = units.sum(axis=1)
    guess = np.zeros((n, len(anchors)))
    for k in range(levels):
        ones = np.bitwise_count(codes[:, k]).sum(axis=1, dtype=np.int64)
        met = np.zeros((n, len(anchors)), np.int32)
        for b in range(PLANES):
            for w in range(words):
                met += np.left_shift(np.bitwise_count(codes[:, k, w, None] & planes[None, :, b, w]), b, dtype=np.int32)
        product = (least * (2 * ones - dims)[:, None] + step * (2.0 * met - total)) / np.sqrt(dims)
        guess += alignments[:, k, None] * product
    width = rest[:, None] * np.sqrt(np.maximum(size - product * product, 0)) + norms[:, None] * (missed + 1e-9 * np.sqrt(size))
    return guess - width, guess + width


def exact(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Integer inner products of matching rows as long; beyond what doubles hold exactly they are computed by Python's integers and kept within long."""
    if not len(rows):
        return np.empty(0, np.int64)
    if np.abs(rows).max() * np.abs(anchors).max() * rows.shape[1] < 2**53:
        return np.einsum("ij,ij->i", rows, anchors).astype(np.int64)
    whole = [sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for a, b in zip(rows, anchors, strict=True)]
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in whole], np.int64)


def nth_largest(values: np.ndarray, n: int) -> np.ndarray:
    """Of every column; -inf where it has fewer than ``n`` values above that."""
    if len(values) < n:
        return np.full(values.shape[1], -np.inf)
    return np.partition(values, len(values) - n, axis=0)[len(values) - n]


def first_of(groups: tuple[np.ndarray, ...], ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` rows with the greatest scores (ties: least id) of every group."""
    order = np.lexsort((ids, -scores.astype(object) if (scores == -(2**63)).any() else -scores, *groups[::-1]))
    keys = np.stack([g[order] for g in groups], axis=1)
    new = np.ones(len(order), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - begin < n]


class Pack:
    """A pack's rows as arrays."""

    def __init__(self, row, dims: int) -> None:
        n, words = row.n, -(-dims // 64)
        self.ids, self.labels = np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64)
        self.vectors = np.frombuffer(row.vectors).reshape(n, row.dims)
        self.codes = np.frombuffer(row.codes, np.uint64).reshape(n, -1, words)
        self.alignments, self.rest = np.frombuffer(row.alignments).reshape(n, -1), np.frombuffer(row.rest)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))


def usable(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, vector (floors of scaled components) of the rows that take part."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("vector"))


def packs(rows: DataFrame, dims: int, size: int, levels: int) -> DataFrame:
    """Packs of about ``size`` rows, dealt evenly and coded; they are numbered by the partition they were made in."""
    count = max(1, -(-rows.count() // size))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, labels, vectors = [], [], []
        for batch in batches:
            ids.append(batch["vec_id"].to_numpy(np.int64))
            labels.append(batch["label"].to_numpy(np.int64))
            some = np.zeros((len(batch), dims))
            for row, v in zip(some, batch["vector"], strict=True):
                row[: len(v)] = v
            vectors.append(some)
        if not sum(map(len, ids)):
            return
        some = np.concatenate(vectors)
        codes, alignments, rest = encode(some, levels)
        parts = [np.concatenate(ids), np.concatenate(labels), some, codes, alignments, rest]
        ids, labels, some, codes, alignments, rest = (np.ascontiguousarray(p).tobytes() for p in parts)
        yield pd.DataFrame({"pack": [TaskContext.get().partitionId()], "n": [len(parts[0])], "ids": [ids], "labels": [labels], "dims": [dims], "vectors": [some], "codes": [codes], "alignments": [alignments], "rest": [rest]})

    return stage(rows.repartition(count).mapInPandas(work, CODED))


def cells(rows: DataFrame, anchors: DataFrame, work, schema: str) -> DataFrame:
    """``work`` over every pair of packs."""
    numbers = lambda df: F.explode(F.sequence(F.lit(0), F.lit(df.agg(F.max("pack")).first()[0])))
    left = rows.withColumnRenamed("pack", "row_pack").withColumn("anchor_pack", numbers(anchors))
    right = anchors.withColumnRenamed("pack", "anchor_pack").withColumn("row_pack", numbers(rows))
    key = ["row_pack", "anchor_pack"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(work, schema)


def best_positives(rows: DataFrame, anchors: DataFrame, dims: int, count: int) -> DataFrame:
    """anchor_pack, anchor (place in its pack), vec_id, score, turn: the first ``count`` other rows of an anchor's label."""

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"anchor_pack": [], "anchor": [], "vec_id": [], "score": []})
        r, a = Pack(next(left.itertuples()), dims), Pack(next(right.itertuples()), dims)
        found = []
        # Rows of one label at a time: no other can be a positive.
        for label in np.intersect1d(np.unique(a.labels), np.unique(r.labels)):
            mine, theirs = np.flatnonzero(a.labels == label), np.flatnonzero(r.labels == label)
            for at in range(0, len(mine), TILE):
                tile = mine[at : at + TILE]
                low, high = intervals(r.codes[theirs], r.alignments[theirs], r.rest[theirs], r.norms[theirs], a.vectors[tile])
                other = r.ids[theirs][:, None] != a.ids[tile][None]
                needed = nth_largest(np.where(other, low, -np.inf), count)
                i, j = np.nonzero(other & ~(high < needed))
                found.append((tile[j], r.ids[theirs[i]], exact(r.vectors[theirs[i]], a.vectors[tile[j]])))
        if not found:
            return pd.DataFrame({"anchor_pack": [], "anchor": [], "vec_id": [], "score": []})
        anchor, vec_id, score = (np.concatenate(c) for c in zip(*found, strict=True))
        keep = first_of((anchor,), vec_id, score, count)
        return pd.DataFrame({"anchor_pack": right["anchor_pack"].iloc[0], "anchor": anchor[keep], "vec_id": vec_id[keep], "score": score[keep]})

    best = cells(rows, anchors, work, "anchor_pack int, anchor int, vec_id long, score long")
    order = Window.partitionBy("anchor_pack", "anchor").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= count)


def best_negatives(rows: DataFrame, anchors: DataFrame, dims: int, count: int, low_percent: int, high_percent: int) -> DataFrame:
    """anchor_pack, anchor, turn, negative_id, negative_score of the rows within a positive's window, the first ``count`` of every cell.

    ``anchors`` has a column ``found`` with (anchor, turn, score) of the positives.
    """

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"anchor_pack": [], "anchor": [], "turn": [], "negative_id": [], "negative_score": []})
        if not len(left) or not len(right):
            return none
        pack = next(right.itertuples())
        r, a = Pack(next(left.itertuples()), dims), Pack(pack, dims)
        # Windows in integers: low * p <= 100 * s <= high * p.
        anchor, turn, score = (np.array([f[k] for f in pack.found], np.int64) for k in ("anchor", "turn", "score"))
        least = np.array([-(-low_percent * int(s) // 100) for s in score], object)
        most = np.array([high_percent * int(s) // 100 for s in score], object)
        windows: dict[int, list] = {}
        for k, t, lo, hi in zip(anchor.tolist(), turn.tolist(), least, most, strict=True):
            if lo <= hi:
                windows.setdefault(k, []).append((t, int(lo), int(hi)))
        asked = np.array(sorted(windows), np.int64)
        found = []
        for at in range(0, len(asked), TILE):
            tile = asked[at : at + TILE]
            low, high = intervals(r.codes, r.alignments, r.rest, r.norms, a.vectors[tile])
            other = r.labels[:, None] != a.labels[tile][None]
            for j, k, t, lo, hi in ((j, k, *w) for j, k in enumerate(tile.tolist()) for w in windows[k]):
                wide_lo, wide_hi = lo - 1e-9 * abs(lo), hi + 1e-9 * abs(hi)
                mine = np.flatnonzero(other[:, j] & ~(high[:, j] < wide_lo) & ~(low[:, j] > wide_hi))
                sure = low[mine, j][(low[mine, j] >= lo) & (high[mine, j] <= hi)]
                if len(sure) >= count:
                    mine = mine[~(high[mine, j] < np.partition(sure, len(sure) - count)[len(sure) - count])]
                s = exact(r.vectors[mine], np.broadcast_to(a.vectors[k], (len(mine), dims)))
                within = (s >= lo) & (s <= hi)
                mine, s = mine[within], s[within]
                best = first_of((np.zeros(len(mine), np.int64),), r.ids[mine], s, count)
                found.append((np.full(len(best), k), np.full(len(best), t), r.ids[mine[best]], s[best]))
        if not found:
            return none
        anchor, turn, ids, s = (np.concatenate(c) for c in zip(*found, strict=True))
        return pd.DataFrame({"anchor_pack": pack.anchor_pack, "anchor": anchor, "turn": turn, "negative_id": ids, "negative_score": s})

    return cells(rows, anchors, work, "anchor_pack int, anchor int, turn int, negative_id long, negative_score long")


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90,
    scale: int = SCALE, levels: int = LEVELS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has integer vec_id and label and an ``embedding`` array; other columns are ignored.
    Components become floor(``scale`` * x), a score is the integer inner product with the anchor, and
    higher scores come first, ties by the lesser vec_id.  Every row that ``anchors`` picks has its
    first ``positives`` other rows of its label (a row with the anchor's vec_id is none of them), and
    for each the first ``negatives`` rows of other labels with low_percent * positive_score <=
    100 * negative_score <= high_percent * positive_score.

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part.
    Shorter vectors are filled up with zeros, an empty one scores 0 with all.  Repeated rows count as
    often as they stand.  No rows, no anchors or no partners give an empty result.
    """
    good = usable(rows, scale)
    dims = good.agg(F.max(F.size("vector"))).first()[0]
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    nothing = rows.sparkSession.createDataFrame([], schema)
    if dims is None:
        return nothing
    dims = max(1, dims)
    coded = packs(good, dims, max(64, PACK // dims), levels)
    asked = packs(good.where(anchors), dims, max(64, ANCHOR_PACK // dims), levels)
    if asked.isEmpty():
        return nothing
    best = stage(best_positives(coded, asked, dims, positives))
    found = best.groupBy(F.col("anchor_pack").alias("pack")).agg(F.collect_list(F.struct("anchor", "turn", "score")).alias("found"))
    best = best.withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"})
    # Without packs that no positive was found for, cells of theirs have one side only.
    negative = best_negatives(coded, asked.join(found, "pack"), dims, negatives, low_percent, high_percent)
    key = ["anchor_pack", "anchor", "turn"]
    order = Window.partitionBy(*key).orderBy(F.desc("negative_score"), "negative_id")
    negative = negative.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, ids in zip(batch["pack"], batch["ids"], strict=True):
                ids = np.frombuffer(ids, np.int64)
                yield pd.DataFrame({"anchor_pack": p, "anchor": np.arange(len(ids)), "anchor_id": ids})

    named = asked.select("pack", "ids").mapInPandas(names, "anchor_pack int, anchor int, anchor_id long")
    return negative.join(best, key).join(named, key[:2]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
